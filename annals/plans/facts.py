"""Queries over fragments, record plans, merges and debates."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.functions.text import normalize_surface
from annals.operators import fragments
from annals.plans import oracle as o
from annals.plans.events import KEYS, M, keyed, mentions
from annals.sources.files import plan
from annals.session import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


POINT = lambda test, n: f"case when {test} then {n} else 0 end"
HAS_YEAR, HAS_PLACE = f"regexp_matches(low, {o.q(fragments.YEAR)})", f"(regexp_matches(low, {o.q('(^|[^a-z0-9])(' + '|'.join(fragments.PLACES) + ')([^a-z0-9]|$)')}) or regexp_matches(low, {o.q(fragments.AFTER_CUE)}))"


#: Every third fragment lacks its years, every fifth its names.
SPOKEN = "case when event_id % 3 = 0 then translate(sentence, '0123456789', '') when event_id % 5 = 0 then translate(sentence, '0123456789PLSEWRN', '') else sentence end"


@query(
    "filter_score_fragments",
    f"""with m as (select event_id, {SPOKEN} as t, lower({SPOKEN}) as low from ({M})),
    s as (select event_id, {POINT(HAS_YEAR, 30)} + {POINT(o.any_of("low", fragments.verb_parts()), 30)} + {POINT(HAS_PLACE, 25)} + {POINT(f"{HAS_YEAR} and {HAS_PLACE} and regexp_matches(t, {o.q(fragments.PERSON)})", 15)} as score from m)
    select event_id, score, score >= 45 as accepted from s""",
)
def filter_score_fragments(spark, sf_dir):
    rows = mentions(spark, sf_dir).selectExpr("event_id", f"{SPOKEN} as t").select("event_id", fragments.fragment_score(F.col("t")).alias("score"))
    return rows.withColumn("accepted", F.col("score") >= 45)


@query(
    "dump_plan_counts",
    """select case when text is null or trim(text) = '' then 'unusable' when lower(lang) <> 'en' then 'other_language' when not contains(lower(text), 'there') then 'off_subject' else 'ingest' end as plan, source, count(*) as n
    from documents group by all""",
)
def dump_plan_counts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    rows = d.select(F.lit(None).cast("string").alias("title"), "text", F.col("lang").alias("language"), "source", F.lit(False).alias("broken"), full.alias("usable"))
    return plan(rows, "en", "there").groupBy("plan", "source").agg(F.count("*").alias("n"))


@query(
    "merge_found_events",
    f"""with m as ({M}), a as (select person, min(event_id) as event_id from m where event_id % 2 = 0 group by person), b as (select person, min(event_id) as event_id from m where event_id % 2 = 1 group by person)
    select * from a union all select * from b where person not in (select person from a)""",
)
def merge_found_events(spark, sf_dir):
    m = mentions(spark, sf_dir)
    least = lambda rows: rows.groupBy("person").agg(F.min("event_id").alias("event_id"))
    return fragments.merge_found(least(m.filter("event_id % 2 = 0")), least(m.filter("event_id % 2 = 1")), "person")


@query(
    "merge_found_whole",
    f"""with m as ({M}), a as (select person, min(event_id) as event_id from m where event_id % 2 = 0 group by person), b as (select person, min(event_id) as event_id from m where event_id % 2 = 1 group by person)
    select * from a union all select * from b where person not in (select person from a)""",
)
def merge_found_whole(spark, sf_dir):
    """Even and odd events merged, all of both; merge_found_events takes a third of the odd ones."""
    m = mentions(spark, sf_dir)
    least = lambda rows: rows.groupBy("person").agg(F.min("event_id").alias("event_id"))
    return fragments.merge_found(least(m.filter("event_id % 2 = 0")), least(m.filter("event_id % 2 = 1")), "person")


SLUG = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
ASKED = "'Where was ' || person || ' during ' || event_type || ' (' || time_key || ')?'"


@query(
    "debate_facts",
    f"""{KEYS}, p as (select distinct stem, person, event_type, time_key, {o.normal("place_label")} as place from k where {o.normal("place_label")} <> ''),
    c as (select *, count(*) over (partition by stem) as n from p), q as (select *, {ASKED} as question from c where n >= 2)
    select 'debate:' || {SLUG("'where-' || person || '-' || event_type || '-' || time_key")} || ':' || {SLUG("'at-' || place")} as debate_id, question, place as proposition, event_type as category,
        sha256('{{"kind":"place_conflict","proposition":"' || place || '","question":"' || question || '","version":"2"}}') as fingerprint from q""",
)
def debate_facts(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("stem", "person", "event_type", "time_key", normalize_surface(F.col("place_label")).alias("place"))
    return fragments.place_debates(rows)


DATES = f"""select event_id, case event_id % 7 when 0 then 'On 0' || (1 + event_id % 9) || ' ' || n || ', ' || (1700 + event_id % 300) when 1 then 'the 1' || (event_id % 10) || ' of ' || upper(n) || ' ' || (1700 + event_id % 300)
    when 2 then 'dated ' || (1700 + event_id % 300) || '-0' || (1 + event_id % 9) || '-1' || (event_id % 10) || '.' when 3 then '1805-13-40' when 4 then n || ' ' || (1700 + event_id % 300)
    when 5 then (1 + event_id % 900) || ' BC in ' || n else 'some day in ' || n end as surface
    from {{events}} join (values {", ".join(f"({i}, '{n}')" for i, n in enumerate(["January", "May", "Sept", "Mayor", "Dec", "march", "Aug"]))}) as v(k, n) on v.k = (event_id * 3 + user_id) % 7"""


def dates_sql() -> str:
    from annals.functions import time as t

    get = lambda pattern, i: f"nullif(regexp_extract(low, {o.q(pattern)}, {i}), '')::int"
    has = lambda pattern: f"regexp_matches(low, {o.q(pattern)})"
    bc = r"(?:^|[^0-9])([0-9]{1,4})\s*(?:b\.?c|av\.? j)"
    plain = "list_filter(list_transform(list_filter(regexp_split_to_array(low, '[^0-9]'), lambda r: length(r) = 4), lambda r: r::int), lambda y: y between 1 and 2100)[1]"
    months = [(t.month_pattern(n), m) for n, m in t.MONTHS]
    year = "case " + " ".join(f"when {has(p)} then {get(p, 2)}" for p, _ in months) + f" when {has(t.ISO)} then {get(t.ISO, 1)} when {has(bc)} then -{get(bc, 1)} else {plain} end"
    month = "case " + " ".join(f"when {has(p)} then {m}" for p, m in months) + f" when {has(t.ISO)} then {get(t.ISO, 2)} end"
    day = "case " + " ".join(f"when {has(p)} then {get(p, 1)}" for p, _ in months) + f" when {has(t.ISO)} then {get(t.ISO, 3)} end"
    return f"""with d as (select *, lower(surface) as low from ({DATES.format(events="events")})), x as (select event_id, surface, {year} as year, {month} as month, {day} as day from d)
        select event_id, surface, year, month, day, year * 10000 + coalesce(month, 6) * 100 + coalesce(day, 15) as sort_key,
            case when year is null then 'unknown' else 'exact:' || year || ':' || coalesce(month, 0) || ':' || coalesce(day, 0) end as time_key from x"""


@query("typed_dates", dates_sql())
def typed_dates(spark, sf_dir):
    from annals.functions import time as t

    rows = spark.sql(DATES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumn("t", t.calendar_date(F.col("surface")))
    return rows.select("event_id", "surface", "t.year", "t.month", "t.day", t.sort_key(F.col("t")).alias("sort_key"), t.canonical_key(F.col("t")).alias("time_key"))


LABEL = "case event_id % 8 when 6 then 'Siege of ' || place_surface when 7 then 'TREATY OF ' || place_surface || ' (draft)' when 0 then case when event_id % 3 = 0 then 'Slavkov u Brna' when event_id % 3 = 1 then 'Sainte-Hélène' else place_surface end when 1 then place_surface || ' (1796)' when 2 then place_surface || '–Auerstedt' when 3 then 'Essling / ' || place_surface when 4 then 'Battle of ' || place_surface || ' (x)' else upper(place_surface) || ', France' end"


def resolved(key: str) -> str:
    from annals.rules import ALIASES

    known = lambda c: f"case when {c} in ({', '.join(o.q(a[0]) for a in ALIASES)}) then {c} end"
    tries = [known(key), known(f"trim(string_split({key}, '(')[1])")]
    for s in ["–", "-", "/", ","]:
        at = f"instr({key}, '{s}')"
        tries += [f"case when {at} > 0 then {known(f'trim({key}[:{at} - 1])')} end", f"case when {at} > 0 then {known(f'trim({key}[{at} + 1:])')} end"]
    return f"coalesce({', '.join(tries)})"


def alias_value(k: int) -> str:
    from annals.rules import ALIASES

    return "case place " + " ".join(f"when {o.q(a[0])} then {o.q(a[k])}" for a in ALIASES) + " end"


@query(
    "place_alias_resolution",
    f"""with l as (select event_id, {LABEL} as label from ({M})), r as (select *, {resolved("lower(trim(label))")} as place from l) select event_id, place, {alias_value(1)}::double as lat, {alias_value(2)}::double as lon, {alias_value(3)} as precision,
    nullif(trim(string_split(regexp_extract(label, '(?i)^(?:battle of |siege of |treaty of )(.*)$', 1), '(')[1]), '') as title_place, case when lower(label) like 'siege%' then 'siege' when lower(label) like 'treaty%' then 'treaty' else 'battle' end as event_type from r""",
)
def place_alias_resolution(spark, sf_dir):
    from annals.functions import place
    from annals.operators.judge import title_event_type

    rows = mentions(spark, sf_dir).selectExpr("event_id", f"{LABEL} as label")
    label = F.col("label")
    rows = rows.withColumn("found", place.resolve_alias(label))
    return rows.select("event_id", *[F.col(f"found.{c}").alias(n) for c, n in (("alias", "place"), ("lat", "lat"), ("lon", "lon"), ("precision", "precision"))], place.from_title(label).alias("title_place"), title_event_type(label).alias("event_type"))


@query(
    "exploration_reachable",
    """with recursive e as (select distinct user_id as src, event_id as dst from events),
    r as (select 0::bigint as node, 0 as depth union select dst, depth + 1 from r join e on src = node where depth < 3) select node, min(depth)::int as depth from r group by node""",
)
def exploration_reachable(spark, sf_dir):
    from annals.operators.explore import reachable

    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as src", "event_id as dst").distinct()
    return reachable(e, spark.range(1).select(F.col("id").alias("node")), 3)


LINKS = """select 'customer ' || cast(o_custkey as string) as src, 'order ' || cast(o_orderkey as string) as dst from {orders}
    union select 'order ' || cast(l_orderkey as string) as src, 'part ' || cast(l_partkey as string) as dst from {lineitem}"""
SEEDS = ["customer 1", "customer 2", "customer 4", "part 1"]


@query(
    "exploration_whole",
    f"""with recursive l as ({LINKS.format(orders="orders", lineitem="lineitem")}), e as (select src, dst from l union select dst, src from l),
    r as (select unnest([{", ".join(map(o.q, SEEDS))}]) as node, 0 as depth union select dst, depth + 1 from r join e on src = node where depth < 3) select node, min(depth)::int as depth from r group by node""",
)
def exploration_whole(spark, sf_dir):
    """What the seeds reach over all links, both ways, of customers, orders and parts: the nodes grow with the tables."""
    from annals.operators.explore import reachable

    links = spark.sql(LINKS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reachable(both, spark.createDataFrame([(s,) for s in SEEDS], "node string"), 3)


@query("exploration_budgeted")
def exploration_budgeted(spark, sf_dir):
    """Three explorations of all links, the best node first: one reaches its targets, one its number of documents, one runs out of good nodes."""
    from functools import reduce

    from annals.operators.explore import Budget, best_first, laid_out

    links = spark.sql(LINKS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    both = written(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both-ways")
    score = F.crc32(F.col("node").cast("binary"))
    kind = F.split("node", " ")[0]
    nodes = both.select(F.col("src").alias("node")).distinct().withColumns(
        {"score": (score % 100).cast("int"), "source": kind, "timeline": (kind == "order").cast("int"), "mapped": (score % 3 == 0).cast("int")}
    )
    # the nodes and the links with them are made once, for all explorations and their rounds
    nodes = written(nodes, "nodes")
    table = laid_out(both, nodes)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "node string")
    runs = {"targets": ({"timeline": 20, "mapped": 25}, Budget()), "documents": ({"timeline": 10**6}, Budget(documents=70, per_source=40)), "nodes": ({"timeline": 10**6}, Budget(min_score=97))}
    found = [best_first(both, nodes, seeds, targets, budget, links=table).withColumn("run", F.lit(name)) for name, (targets, budget) in runs.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    "changed_documents",
    """with o as (select doc_id, case when doc_id % 5 = 0 then upper(text) else text end as text from documents where doc_id % 3 <> 0)
    select doc_id, n_chars from documents d where not exists (select 1 from o where o.doc_id = d.doc_id and sha256(coalesce(o.text, '')) = sha256(coalesce(d.text, '')))""",
)
def changed_documents(spark, sf_dir):
    from annals.operators.store import changed

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return changed(d, old, "doc_id", "text").select("doc_id", "n_chars")
