"""Queries that read tables with their parents: sections and pages, candidates and sentences, hits, density counts, years of a life."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.functions import text, time
from annals.operators import judge as judges, reads, stage
from annals.plans import oracle as o
from annals.plans.corpus import read
from annals.plans.events import M, STAGED, mentions, staged
from annals.session import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


PAGES = """select user_id as page_id, case when user_id % 3 = 0 then 'fr' else 'en' end as lang, 'Page ' || cast(user_id as string) as page_title, user_id * 10 as revision,
    '  intro ' || cast(count(*) as string) || '\n== Life ==\nborn ' || cast(min(event_id) as string) || '\n\nlast\n=== Work ===\n' || case when user_id % 2 = 0 then '' else 'wrote' end || '\n==Notes==' as body from {events} group by user_id"""


def pages(spark, sf_dir):
    # the lines of the bodies are given by a character that SQL texts can hold
    return spark.sql(PAGES.replace("\n    ", " ").replace("\n", "\\n"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(
    "sections_of_pages",
    """with p as (select user_id as page_id, case when user_id % 3 = 0 then 'fr' else 'en' end as lang, 'Page ' || user_id as page_title, user_id * 10 as revision, count(*) as n, min(event_id) as least from events group by user_id),
    s as (select *, 0 as ordinal, 'Lead' as title, 'intro ' || n as body from p union all select *, 1, 'Life', 'born ' || least || chr(10) || chr(10) || 'last' from p
          union all select *, 2, 'Work', case when page_id % 2 = 0 then '' else 'wrote' end from p union all select *, 3, 'Notes', '' from p)
    select page_id, ordinal, title, body, page_title, revision from s where lang = 'en' and page_title ilike 'PAGE %1%'""",
)
def sections_of_pages(spark, sf_dir):
    """Sections of the English pages whose title fits a pattern."""
    p = pages(spark, sf_dir)
    found = reads.sections_of_pages(text.sections(p, "page_id", "body"), p, "en", pattern="PAGE %1%")
    return found.select("page_id", "ordinal", "title", "body", "page_title", "revision")


@query(
    "pending_with_sentences",
    f"""select event_id as candidate_id, person, verb, 'turn ' || c.role || ' ' || c.turn as sentence from ({M}) m join conversations c on c.conv_id * 1000 + c.turn = (m.event_id % 200) * 1000 + m.event_id % 7 where m.event_id % 4 <> 0""",
)
def pending_with_sentences(spark, sf_dir):
    """Candidates that wait, with the sentence that they were taken from."""
    key = F.col("event_id")
    rows = mentions(spark, sf_dir).select(
        key.alias("candidate_id"), "person", "verb", ((key % 200) * 1000 + key % 7).alias("sentence_id"), F.when(key % 4 == 0, "accepted").otherwise("pending").alias("status")
    )
    turns = read(spark, sf_dir, "conversations")
    sentences = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence_id"), F.concat(F.lit("turn "), "role", F.lit(" "), F.col("turn").cast("string")).alias("sentence"))
    return reads.pending_candidates(rows, sentences).select("candidate_id", "person", "verb", "sentence")


SAID = "lower(verb || case event_id % 5 when 0 then ' french painter' when 1 then ' album of a singer' when 2 then ' located in Rome' when 3 then ' prime minister' else '' end)"


@query(
    "person_hits",
    f"""with h as (select user_id % 20 as search, event_id as qid, {SAID} as s from ({M})),
    p as (select search, qid, qid % 9 = 0 and exists (select 1 from customer where c_custkey = qid) as local, case when {o.word_of("s", rules.PERSON_WORDS)} or {o.any_of("s", rules.PERSON_PARTS)} then 50 else 0 end
        - case when {o.any_of("s", rules.THING_PARTS)} then 70 else 0 end - case when {o.any_of("s", rules.PLACE_PARTS)} then 35 else 0 end as score from h)
    select search, qid, local, score, (row_number() over (partition by search order by local desc, score desc, qid))::int as place from p qualify place <= 10""",
)
def person_hits(spark, sf_dir):
    """The ten best hits of each search: persons that are known here first, then by score."""
    rows = mentions(spark, sf_dir).selectExpr("user_id % 20 as search", "event_id as qid", f"{SAID} as s").withColumn("score", judges.person_score(F.col("s")))
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")).filter("qid % 9 = 0")
    return reads.ranked_hits(rows, known, "search", 10).select("search", "qid", "local", "score", "place")


@query(
    "density_counts",
    f"""{STAGED}, r as (select distinct user_id as run_id, 'Person ' || user_id as subject from events), d as (select page_id % 40 as run_id from pages), s as (select doc_id, 'Person ' || (doc_id % 25) as subject from documents),
    t as (select occurrence_key, min(event) as event_id, count(*) as support from staged where event is not null group by occurrence_key),
    e as (select k.person as subject, k.year, k.map_eligible as mapped, support from t join k using (event_id)),
    a as (select subject, count(*) as v from d join r using (run_id) group by 1), b as (select subject, count(*) as v from s group by 1), f as (select subject, count(*) as v from conversations join s on conv_id = doc_id group by 1),
    c as (select person as subject, count(*) as n, count(*) filter (outcome = 'rejected') as x, count(*) filter (outcome = 'needs_review') as y, count(distinct (stem, place)) as z from staged group by 1),
    g as (select subject, count(*) as n, count(year) as t, count(*) filter (mapped) as m, count(*) filter (year is not null and not mapped) as w, count(*) filter (support > 1) as q from e group by 1),
    u as (select subject from a union select subject from b union select subject from f union select subject from c union select subject from g), z as (select 0::bigint as o)
    select subject, coalesce(a.v, o) as documents_discovered, coalesce(b.v, o) as documents_snapshotted, coalesce(f.v, o) as fragments, coalesce(c.n, o) as candidates, coalesce(x, o) as rejected, coalesce(y, o) as needs_review, coalesce(c.z, o) as claims,
        coalesce(g.n, o) as accepted_events, coalesce(t, o) as timeline_eligible, coalesce(m, o) as map_eligible, coalesce(w, o) as events_without_place, coalesce(q, o) as multi_source_events
    from u cross join z left join a using (subject) left join b using (subject) left join f using (subject) left join c using (subject) left join g using (subject)""",
)
def density_counts(spark, sf_dir):
    """By subject twelve counts, from what was discovered to events of several sources."""
    decided = staged(spark, sf_dir).select("event_id", F.col("person").alias("subject"), "stem", "place", "occurrence_key", "outcome", "event", "year", "map_eligible")
    decided = written(decided, "decided")  # read four times
    kept = decided.select("event_id", "subject", "year", F.col("map_eligible").alias("mapped"))
    events = stage.event_table(decided).select("event_id", "support").join(kept, "event_id")
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    runs = users.withColumn("subject", F.concat(F.lit("Person "), F.col("run_id").cast("string")))
    snapshots = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("snapshot_id"), F.concat(F.lit("Person "), (F.col("doc_id") % 25).cast("string")).alias("subject"))
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("snapshot_id"))
    return reads.density_counts(runs, read(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("run_id")), snapshots, turns, decided, events)


LIVED = "sentence || case event_id % 6 when 0 then ' In 44 BC and 1799.' when 1 then ' 12345 and 300 av. J.-C.' when 2 then ' born 1700, 1850b.c' else '' end"


@query(
    "year_first_in_lifespan",
    f"""with m as (select event_id, {LIVED} as s, case when event_id % 4 <> 0 then 1780 + user_id % 30 end as birth, case when event_id % 3 <> 0 then 1820 + user_id % 30 end as death from ({M})),
    w as (select *, coalesce(birth - 2, death - 120, -4000) as lo, coalesce(death + 5, least(2025, birth + 120), 2025) as hi from m),
    b as (select *, list_filter(list_transform(regexp_extract_all(lower(s), '(?:^|[^0-9])([0-9]{{1,4}})\\s*(?:b\\.?c|av\\.? j)', 1), lambda x: x::int), lambda y: -y between lo and hi)[1] as bc,
                 list_filter(list_transform(list_filter(regexp_split_to_array(s, '[^0-9]'), lambda r: length(r) = 4), lambda r: r::int), lambda y: y between lo and hi)[1] as ad from w)
    select event_id, coalesce(bc::varchar || ' BC', ad::varchar) as year from b""",
)
def year_first_in_lifespan(spark, sf_dir):
    """The first year of a sentence that lies in the life of its person."""
    rows = mentions(spark, sf_dir).selectExpr(
        "event_id", f"{LIVED} as s", "cast(case when event_id % 4 <> 0 then 1780 + user_id % 30 end as int) as birth", "cast(case when event_id % 3 <> 0 then 1820 + user_id % 30 end as int) as death"
    )
    rows = rows.withColumn("w", time.life_window(F.col("birth"), F.col("death"), 2025))
    return rows.select("event_id", time.first_year(F.col("s"), F.col("w.first"), F.col("w.last")).alias("year"))
