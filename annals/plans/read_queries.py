"""Reading queries. Customers stand in for entities and orders for their events; conversations for sentences and documents for their pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from annals.functions import ident, time
from annals.functions.place import coordinates, gazetteer
from annals.operators import assembly, judge as judges, metrics, reads, stage, versions
from annals.plans import oracle as o
from annals.plans.corpus import read
from annals.plans.events import CLAIM, JUDGED, KEYS, M, STAGED, judged, keyed, mentions, staged
from annals.session import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


NAME = "case when c_custkey % 7 = 0 then 'Éloïse ' else 'Person ' end || c_custkey"
EVENT_YEAR = "case when o_orderkey % 11 <> 0 then year(o_orderdate)::int end"


def entities_and_events(spark, sf_dir):
    key = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").select(key.alias("entity_id"), F.concat(F.when(key % 7 == 0, "Éloïse ").otherwise("Person "), key).alias("name"), F.col("c_mktsegment").alias("slug"))
    year = F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate"))
    events = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("event_id"), year.alias("year"))
    return events, people


@query("timeline_entities", f"select o_orderkey as event_id, c_custkey as entity_id, {NAME} as name, {EVENT_YEAR} as year from orders join customer on c_custkey = o_custkey")
def timeline_entities(spark, sf_dir):
    """Events with their entities, without filters."""
    events, people = entities_and_events(spark, sf_dir)
    return reads.timeline(events, people).select("event_id", "entity_id", "name", "year")


@query(
    "timeline_of_profile",
    f"""select o_orderkey as event_id, c_custkey as entity_id, {NAME} as name, {EVENT_YEAR} as year from orders join customer on c_custkey = o_custkey
    where c_mktsegment = 'FURNITURE' and contains(lower(strip_accents({NAME})), 'eloise 1') and ({EVENT_YEAR} is null or {EVENT_YEAR} between 1994 and 1996)""",
)
def timeline_of_profile(spark, sf_dir):
    """Events of the entities of a profile whose names match without accents, in a period."""
    events, people = entities_and_events(spark, sf_dir)
    rows = reads.timeline(events, people.select("entity_id", "name"), people.select("entity_id", "slug"), person="eloïse 1", profile="FURNITURE", first=1994, last=1996)
    return rows.select("event_id", "entity_id", "name", "year")


@query(
    "geocode_applied",
    f"""{JUDGED}, g as (select lower(trim(place_label)) as k, min(strlen(place_label))::double as g from judged where starts_with(place_label, 'N') or place_label = 'his house' group by 1)
    select event_id, coalesce(lat, g) as lat, case when lat is null then -g else lon end as lon, map_eligible or (lat is null and g is not null) as map_eligible, lat is null and g is not null as geocoded
    from judged left join g on k = lower(trim(place_label))""",
)
def geocode_applied(spark, sf_dir):
    """Looked-up coordinates for the labels that had none."""
    rows = judged(spark, sf_dir)
    wanted = mentions(spark, sf_dir).select(F.regexp_replace(F.trim("place_surface"), r"\.+$", "").alias("label")).filter("startswith(label, 'N') or label = 'his house'")
    codes = wanted.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min(F.octet_length("label")).cast("double").alias("g_lat")).withColumn("g_lon", -F.col("g_lat"))
    return reads.apply_geocodes(rows, codes).select("event_id", "lat", "lon", "map_eligible", "geocoded")


def fragments(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("snapshot_id"), "turn")
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("snapshot_id"), "source")
    judgments = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("snapshot_id"), (F.col("quality") == 1).alias("accepted"))
    return turns, pages, judgments


@query("accepted_fragments", "select conv_id, turn, source from conversations join documents d on d.doc_id = conv_id where exists (select 1 from labels l where l.doc_id = conv_id and quality = 1)")
def accepted_fragments(spark, sf_dir):
    return reads.judged_fragments(*fragments(spark, sf_dir), True, ["snapshot_id"]).select(F.col("snapshot_id").alias("conv_id"), "turn", "source")


@query("unjudged_fragments", "select conv_id, turn, source from conversations join documents d on d.doc_id = conv_id where not exists (select 1 from labels l where l.doc_id = conv_id) and source = (select min(source) from documents)")
def unjudged_fragments(spark, sf_dir):
    """Fragments of one source that wait for a judgment."""
    turns, pages, judgments = fragments(spark, sf_dir)
    least = pages.agg(F.min("source").alias("source"))
    return reads.judged_fragments(turns, pages.join(F.broadcast(least), "source"), judgments, False, ["snapshot_id"]).select(F.col("snapshot_id").alias("conv_id"), "turn", "source")  # one row


@query(
    "claim_sentences",
    """with s as (select conv_id * 1000 + turn as sentence_id, conv_id as page_id, role, turn from conversations),
    e as (select c_custkey as entity_id, 'Page ' || c_custkey * 3 as title from customer), c as (select sentence_id, case when sentence_id % 2 = 0 then sentence_id % 97 end as entity_id from s where turn % 5 < 2),
    p as (select doc_id as page_id, 'Page ' || doc_id as title from documents)
    select s.sentence_id, p.title, coalesce(e.entity_id, c.entity_id) as entity_id from s join p using (page_id) left join e using (title) left join c on c.sentence_id = s.sentence_id
    where coalesce(e.entity_id, c.entity_id) is not null and not (role = 'system')""",
)
def claim_sentences(spark, sf_dir):
    """Sentences to take claims from: an entity is known and no claim stands on them yet."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence_id"), F.col("conv_id").alias("page_id"), "role", "turn")
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Page "), "doc_id").alias("title"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Page "), F.col("c_custkey") * 3).alias("title"))
    named = turns.filter("turn % 5 < 2").select("sentence_id", F.when(F.col("sentence_id") % 2 == 0, F.col("sentence_id") % 97).alias("entity_id"))
    used = turns.filter("role = 'system'").select("sentence_id")
    return reads.claim_sentences(turns.select("sentence_id", "page_id"), pages, people, named, used).select("sentence_id", "title", "entity_id")


EVIDENCE = """select event_id, event_id * 3 + k as evidence_id, event_id * 3 + k as sentence_id, case when (event_id + k) % 4 = 0 then null else cast((event_id * 7 + k * 13) % 5 as int) end as confidence,
    case when (event_id + k) % 3 = 0 then 'quote ' || cast(event_id * 3 + k as string) end as quoted_text from {events} cross join (values (0), (1), (2)) as x(k) where event_id % 13 <> 0 and event_id % 3 >= k"""
SAID = "select event_id * 3 as sentence_id, user_id as page_id, event_type as sentence from {events} union all select event_id * 3 + 1, user_id, 'other ' || event_type from {events}"
REVISIONS = "select distinct user_id as page_id, case when user_id % 7 <> 0 then 'en' end as lang, 'Page ' || cast(user_id as string) as title, case when user_id % 5 <> 0 then user_id * 100 end as revision from {events}"


@query(
    "claims_backfill",
    f"""{KEYS}, ev as ({EVIDENCE.format(events="events")}), s as ({SAID.format(events="events")}), p as ({REVISIONS.format(events="events")}),
    best as (select * from ev qualify row_number() over (partition by event_id order by confidence desc nulls last, evidence_id) = 1),
    b as (select event_id, coalesce(quoted_text, sentence) as quote, 'https://' || lang || '.wikipedia.org/w/index.php?title=' || replace(title, ' ', '_') || '&oldid=' || revision as locator
          from best left join s using (sentence_id) left join p using (page_id))
    select event_id, case event_type when 'anecdote' then 'anecdote' else 'life_event' end as kind, 'attested' as status, 'direct' as relation, score as confidence, title as text, quote, locator
    from k left join b using (event_id) where not exists (select 1 from ({M}) m where m.event_id = k.event_id and m.event_id % 5 = 0)""",
)
def claims_backfill(spark, sf_dir):
    """A claim for each event that has none, with its best evidence."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    claimed = mentions(spark, sf_dir).filter("event_id % 5 = 0").select("event_id")
    rows = keyed(spark, sf_dir).select("event_id", "event_type", F.col("title").alias("text"), F.col("score").alias("confidence"))
    return reads.backfill_claims(rows, claimed, *[spark.sql(s, events=events) for s in (EVIDENCE, SAID, REVISIONS)])


@query(
    "competing_abstention",
    f"""{STAGED} select event_id, competes as conflict, places, case when competes then 'needs_review' when last > event_id then 'uncertain' else status end as status from staged left join disputed using (stem)""",
)
def competing_abstention(spark, sf_dir):
    """Where sources disagree on the place the first reading turns uncertain and those that differ go to review."""
    rows = reads.abstained(staged(spark, sf_dir))
    return rows.select("event_id", "conflict", F.array_join("places", ",").alias("places"), "status")


#: Most sentences without what makes a claim sure.
RARE = "case when event_id % 97 = 0 then sentence else 'Perhaps so, it is said' end"


@query(
    "claims_by_confidence",
    f"""with m as (select event_id, lower({RARE}) as s from ({M})), c as (select event_id, {CLAIM(1, "life_event", "context", "fact")} as kind, {CLAIM(4, 65, 45, 40)} as confidence from m)
    select * from c order by confidence desc, event_id limit 200""",
)
def claims_by_confidence(spark, sf_dir):
    """The 200 surest claims, ties by id."""
    rows = mentions(spark, sf_dir).selectExpr("event_id", f"{RARE} as s").select("event_id", *[judges.claim_class(F.col("s"), v).alias(n) for v, n in ((1, "kind"), (4, "confidence"))])
    return rows.orderBy(F.desc("confidence"), "event_id").limit(200)


KNOWN = f"""select place_surface as surface, case when place_surface = 'Notre-Dame' then 'person' when place_surface = 'The Coalition' then 'organization' else 'place' end as kind, upper(place_surface) as label
    from (select distinct place_surface from ({{mentions}})) x where place_surface in ('Notre-Dame', 'The Coalition') or lower(place_surface) in ({', '.join(o.q(g[0]) for g in gazetteer())})"""


THING = "case event_id % 4 when 0 then 'notre-dame' when 1 then ' The treaty' when 2 then '' end"
TOLD = lambda c: f"array_join(transform({c}, m -> concat(m.surface, ':', m.kind, ':', coalesce(m.role, '-'))), ',')"


@query(
    "mention_resolution",
    f"""with e as ({KNOWN.format(mentions=M)}), r0 as (select event_id, person, nullif(trim(place_surface), '') as raw, e.kind, e.label, nullif(trim({THING}), '') as thing from ({M}) m left join e on lower(trim(e.surface)) = lower(trim(m.place_surface))),
    r as (select r0.*, coalesce(t.kind, 'unknown') as what, coalesce(t.label, thing) as named, c.kind as ally_kind, c.label as ally from r0 left join e t on lower(t.surface) = lower(thing) left join e c on c.surface = 'The Coalition')
    select event_id, case when raw is not null and coalesce(kind, 'place') = 'place' then coalesce(label, raw) end as place_label, case when raw is not null and coalesce(kind, 'place') = 'place' then coalesce(kind, 'unknown') end as place_kind,
           case when raw is null then null when kind = 'person' then 'participant' when kind = 'organization' then 'object' end as mention_role, coalesce(raw is not null and kind in ('person', 'organization'), false) as invalid_place,
           concat_ws(',', case when raw is not null and kind = 'organization' then label || ':' || kind || ':-' end, case when thing is not null and what <> 'person' then named || ':' || what || ':-' end) as objects,
           concat_ws(',', case when raw is not null and kind = 'person' then label || ':person:spouse' end, case when thing is not null and what = 'person' then named || ':person:spouse' end,
               case when event_id % 5 = 0 then person || ':unknown:witness' end, case when event_id % 5 = 0 then coalesce(ally, 'The Coalition') || ':' || coalesce(ally_kind, 'unknown') || ':ally' end) as participants from r""",
)
def mention_resolution(spark, sf_dir):
    """What the surfaces of places, objects and participants turn out to be."""
    others = "case when event_id % 5 = 0 then array(struct(person as surface, 'witness' as role), struct('The Coalition' as surface, 'ally' as role)) end"
    m = mentions(spark, sf_dir).selectExpr("event_id", "place_surface", f"{THING} as thing", f"{others} as others")
    surface = F.col("place_surface")
    kind = F.when(surface == "Notre-Dame", "person").when(surface == "The Coalition", "organization").otherwise("place")
    known = m.select("place_surface").distinct().filter(surface.isin("Notre-Dame", "The Coalition") | coordinates(surface).isNotNull())
    entities = known.select(surface.alias("surface"), kind.alias("kind"), F.upper(surface).alias("label"))
    rows = reads.resolve_mentions(m, entities, "place_surface", "thing", "others", "event_id")
    return rows.select("event_id", "place_label", "place_kind", "mention_role", "invalid_place", F.expr(TOLD("object_mentions")).alias("objects"), F.expr(TOLD("participant_mentions")).alias("participants"))


@query(
    "human_entities",
    """with h as (select s_suppkey, case when s_suppkey % 3 = 0 then s_suppkey * 2 end as qid, 'Customer#' || lpad((s_suppkey * 25)::varchar, 9, '0') as title from supplier),
    l as (select s_suppkey, unnest([s_suppkey * 7000, s_suppkey * 5, s_suppkey * 3]) as k, unnest([1, 2, 3]) as i from supplier where s_suppkey % 4 <> 1),
    s as (select s_suppkey, min_by(c_custkey, i) as by_link from l join customer on c_name = 'Customer#' || lpad(k::varchar, 9, '0') group by s_suppkey)
    select s_suppkey, coalesce(a.c_custkey, b.c_custkey, by_link) as entity_id, coalesce(a.c_custkey, b.c_custkey, by_link) is null as is_new
    from h left join customer a on a.c_custkey * 4 = qid left join customer b on b.c_name = title left join s using (s_suppkey)""",
)
def human_entities(spark, sf_dir):
    """Humans find their entity by identifier, else by page title, else by any of their links, else are new."""
    key = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))
    links = F.when(key % 4 != 1, F.array(*[name(key * n) for n in (7000, 5, 3)]))
    humans = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 3 == 0, key * 2).alias("qid"), name(key * 25).alias("title"), links.alias("links"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") * 4).alias("qid"), F.col("c_name").alias("title"))
    found = reads.human_entities(humans, people, ["qid", "title"])
    return reads.by_sitelinks(found, people, "s_suppkey", "links").select("s_suppkey", "entity_id", "is_new")


SOFT = "sentence || case event_id % 9 when 0 then ' It was disputed.' when 1 then ' Historians debate it.' when 2 then ' In theory so.' when 3 then ' An anecdote.' else '' end"
SOFT_CLAIMS = f"with m as (select event_id, person, lower({SOFT}) as s from ({M})), c as (select event_id, person, {CLAIM(1, 'life_event', 'context', 'fact')} as kind, {CLAIM(3, 'direct', 'indirect', 'direct')} as relation, {CLAIM(4, 65, 45, 40)} as confidence from m)"


def soft_claims(spark, sf_dir):
    rows = mentions(spark, sf_dir).selectExpr("event_id", "person", f"{SOFT} as s")
    return rows.select("event_id", "person", *[judges.claim_class(F.col("s"), v).alias(n) for v, n in ((1, "kind"), (3, "relation"), (4, "confidence"))])


@query("debated_claims", f"{SOFT_CLAIMS} select * from c where kind in ('theory', 'controversy', 'debate_stance') or relation = 'historiography'")
def debated_claims(spark, sf_dir):
    """Claims that debates are made of."""
    return reads.claims_of(soft_claims(spark, sf_dir), debates_only=True)


@query("exportable_claims", f"{SOFT_CLAIMS} select person, kind, count(*) as n, max(confidence) as surest from c where kind in ('theory', 'controversy', 'debate_stance') group by all")
def exportable_claims(spark, sf_dir):
    """By person how many claims of which kind can be handed on."""
    return reads.exportable_claims(soft_claims(spark, sf_dir)).groupBy("person", "kind").agg(F.count("*").alias("n"), F.max("confidence").alias("surest"))


@query(
    "conflicting_claims",
    f"""{STAGED} select stem, place, any_value(person) as person, any_value(event_type) as event_type, min(event_id) as first_id, count(*) as support from staged where stem in (select stem from staged where competes) group by stem, place""",
)
def conflicting_claims(spark, sf_dir):
    """The claims of disputed stems."""
    return reads.conflicting_claims(staged(spark, sf_dir)).select("stem", "place", "person", "event_type", "first_id", "support")


@query(
    "event_fingerprints",
    f"""{KEYS} select event_id, {o.joined("'event'", "user_id::varchar", "event_type", "verb_label", "time_key", "lower(place_label)", "least(person, page) || ',' || greatest(person, page)")} as fingerprint from k""",
)
def event_fingerprints(spark, sf_dir):
    """Identity of assembled events, without their titles."""
    c = F.col
    rows = keyed(spark, sf_dir)
    return rows.select("event_id", ident.event_fingerprint(c("user_id"), c("event_type"), c("verb_label"), time.canonical_key(time.typed_time(c("year"), c("time_surface"))), F.lower("place_label"), F.array("person", "page")).alias("fingerprint"))


TABLES = ["documents", "pages", "conversations", "events", "customer", "orders"]


@query("table_counts", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    """How many rows six tables have."""
    return reduce(lambda a, b: a.unionByName(b), [read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES])


@query(
    "status_updates",
    f"""{STAGED}, births as (select person, min(year) as y from k where event_type = 'birth' group by person)
    select event_id, case outcome when 'needs_review' then 'needs_review' when 'rejected' then 'rejected' else 'assembled' end as status, event,
           case when outcome = 'created' then case when last > event_id then 'uncertain' else 'attested' end end as epistemic,
           case when outcome = 'created' then not coalesce(event_type = 'birth' and year is distinct from y, false) end as active
    from staged left join disputed using (stem) left join births using (person)""",
)
def status_updates(spark, sf_dir):
    """Candidates after the changes that the stage makes to them and to their events, merged from versions of changes."""
    rows = written(staged(spark, sf_dir).select("event_id", "person", "event_type", "stem", "outcome", "event", "year"), "decided")  # read for each kind of change
    births = rows.filter("event_type = 'birth'").groupBy("person").agg(F.min("year").alias("born"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    base = rows.select("event_id", F.lit("accepted").alias("status"), none("bigint", "event"), none("string", "epistemic"), none("boolean", "active"))
    created = rows.filter("outcome = 'created'")
    uncertain = created.join(stage.disputes(rows), "stem").filter("disputed > event_id")
    other = created.filter("event_type = 'birth'").join(births, "person").filter(~F.col("year").eqNullSafe(F.col("born")))
    at = lambda df, version, **sets: df.select("event_id", F.lit(version).alias("version"), *[(v if not isinstance(v, (str, bool)) else F.lit(v)).alias(k) for k, v in sets.items()])
    changes = [
        at(rows.filter("event is not null"), 1, status="assembled", event=F.col("event")), at(created, 2, epistemic="attested", active=True),
        at(rows.filter("event is null"), 3, status=F.col("outcome")), at(uncertain, 4, epistemic="uncertain"), at(other, 5, active=False),
    ]
    return versions.merged(base, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes), "event_id")


@query(
    "run_metrics",
    f"""{STAGED}, c as (select outcome, case when competes then 'competing_place' when outcome = 'rejected' then 'singleton_cardinality_violation' end as code, count(*) as n from staged group by all)
    select sum(n)::bigint as candidates, sum(n) filter (outcome = 'created')::bigint as created, sum(n) filter (outcome = 'reinforced')::bigint as reinforced, sum(n) filter (outcome in ('created', 'reinforced'))::bigint as accepted,
           sum(n) filter (outcome = 'needs_review')::bigint as needs_review, sum(n) filter (outcome = 'rejected')::bigint as rejected, string_agg(code || '=' || n, ',' order by code) as losses from c""",
)
def run_metrics(spark, sf_dir):
    """Counts of a run by outcome, and why candidates were lost."""
    found = metrics.loss_reasons(staged(spark, sf_dir))
    losses = F.array_join(F.transform(F.map_entries("losses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("losses", losses)


@query(
    "claim_relations",
    f"""{STAGED}, a as (select event_id, stem, row_number() over (partition by stem order by event_id) as n, lag(event_id) over (partition by stem order by event_id) as earlier, competes from staged)
    select distinct event_id as from_claim, earlier as to_claim, case when competes then 'contradicts' else 'supports' end as relation from a where earlier is not null""",
)
def claim_relations(spark, sf_dir):
    """What each claim says to the one before of its stem; relations that come again, here every third, are there once."""
    before = F.lag("event_id").over(Window.partitionBy("stem").orderBy("event_id"))
    relation = F.when(F.col("outcome") == "needs_review", "contradicts").otherwise("supports")
    new = staged(spark, sf_dir).select(F.col("event_id").alias("from_claim"), before.alias("to_claim"), relation.alias("relation")).filter("to_claim is not null")
    keys = ["from_claim", "to_claim", "relation"]
    return assembly.insert_if_absent(new.filter("from_claim % 3 = 0"), new, keys, keys)
