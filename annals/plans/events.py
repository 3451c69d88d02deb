"""Queries over mentions and events: judging, identity, gates, assembly, timelines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions import ident, place, text, time
from annals.operators import assembly, judge as judges, stage
from annals.plans import oracle as o
from annals.plans.synth import mentions, mentions_sql
from annals.session import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


M = mentions_sql()
JUDGED = f"with {o.judged(M)}"
KEYS = f"""{JUDGED}, k as (
    select *, 'exact:' || year::varchar || ':0:0' as time_key,
           {o.barred(o.normal("person"), "event_type", "verb_label", "'exact:' || year::varchar || ':0:0'", o.normal("place_label"), "''", "''", "''")} as occurrence_key,
           {o.barred(o.normal("person"), "event_type", "verb_label", "'exact:' || year::varchar || ':0:0'", "''", "''", "''", "''")} as stem
    from judged where verdict = 'accept')"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judges.judge(mentions(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates with the key of what happened and its stem without the place."""
    return with_keys(judged(spark, sf_dir).filter("verdict = 'accept'"))


def with_keys(c: DataFrame) -> DataFrame:
    key = time.canonical_key(time.typed_time(F.col("year"), F.col("time_surface")))
    c = c.withColumn("time_key", key)
    parts = [F.col(x) for x in ("person", "event_type", "verb_label", "time_key")]
    return c.withColumns({"occurrence_key": ident.occurrence_key(*parts, F.col("place_label"), F.lit("")), "stem": ident.occurrence_stem(*parts, F.lit(""))})


COLUMNS = ["event_id", "verdict", "score", "event_type", "verb_label", "family", "status", "year", "place_label", "map_eligible", "title"]


@query("judge_verdicts", f"{JUDGED} select {', '.join(COLUMNS)} from judged")
def judge_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select(*COLUMNS)


@query("judge_label_counts", f"{JUDGED} select verdict, event_type, count(*) as n, sum(score)::bigint as points from judged group by all")
def judge_label_counts(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("verdict", "event_type").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


@query("epistemic_status_hist", f"{JUDGED} select status, family, count(*) as n from judged group by all")
def epistemic_status_hist(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("status", "family").agg(F.count("*").alias("n"))


LIFE = f"({o.any_of('s', rules.LIFE_VERBS)} and regexp_matches(s, '[0-9]') and (regexp_matches(s, '[12]') or regexp_matches(s, '(^|[^0-9])[0-9]{{4}}([^0-9]|$)')))"
CLAIM = lambda v, life, context, fact: f"coalesce({o.first(rules.CLAIM_KINDS, lambda p: o.any_of('s', p), v)}, case when {LIFE} then {o.q(life)} when {o.any_of('s', rules.CONTEXT_CUES)} then {o.q(context)} else {o.q(fact)} end)"


@query(
    "claim_kind_classify",
    f"""with m as (select event_id, lower(sentence) as s from ({M}))
    select event_id, {CLAIM(1, "life_event", "context", "fact")} as kind, {CLAIM(2, "attested", "attested", "attested")} as status,
           {CLAIM(3, "direct", "indirect", "direct")} as relation, {CLAIM(4, 65, 45, 40)} as confidence from m""",
)
def claim_kind_classify(spark, sf_dir):
    c = [judges.claim_class(F.col("sentence"), v).alias(n) for v, n in ((1, "kind"), (2, "status"), (3, "relation"), (4, "confidence"))]
    return mentions(spark, sf_dir).select("event_id", *c)


@query("time_parse", f"select event_id, time_surface, {o.year('time_surface')} as year from ({M})")
def time_parse(spark, sf_dir):
    return mentions(spark, sf_dir).select("event_id", "time_surface", time.parse_year(F.col("time_surface")).alias("year"))


TAILED = "sentence || case event_id % 4 when 0 then ' In 1999 and 1805.' when 1 then ' By 1849 or 1850, not 1851.' when 2 then ' In 18 05 or 17811.' else '' end"


@query(
    "year_last_in_window",
    f"""with m as (select event_id, {TAILED} as s from ({M})), n as (select event_id, unnest(regexp_extract_all(s, '[0-9]+')) as d, generate_subscripts(regexp_extract_all(s, '[0-9]+'), 1) as i from m),
    y as (select event_id, i, d::int as y from n where length(d) = 4 and d::int between 1780 and 1850)
    select event_id, max_by(y, i) as year from m left join y using (event_id) group by event_id""",
)
def year_last_in_window(spark, sf_dir):
    return mentions(spark, sf_dir).selectExpr("event_id", f"{TAILED} as s").select("event_id", time.last_year(F.col("s"), F.lit(1780), F.lit(1850)).alias("year"))


@query("place_plausible", f"""select place, n, not (strlen(s) not between 2 and 60 or length(s) - length(replace(s, ' ', '')) > 5 or contains(lower(s), ' the ') or regexp_matches(lower(s), '^(the |a |an |his |her |their |have |fight|chapter)')
    or contains(lower(s), 'coalition') or contains(lower(s), 'claim') or not regexp_matches(s, '^\\p{{L}}') or (contains(s, ' ') and not regexp_matches(s, '\\p{{Lu}}')) or regexp_matches(lower(s), '( on| in| at| of| the|\\(|-)$')) as plausible
    from (select place_surface as place, trim(place_surface) as s, count(*) as n from ({M}) group by all)""")
def place_plausible(spark, sf_dir):
    rows = mentions(spark, sf_dir).groupBy(F.col("place_surface").alias("place")).agg(F.count("*").alias("n"))
    return rows.withColumn("plausible", place.plausible(F.col("place")))


BEST = " ".join(
    f"when instr(s, {o.q(n)}) > 0 and (instr(s, {o.q(n)}) = 1 or not regexp_matches(s[instr(s, {o.q(n)}) - 1], '^[a-z0-9]$')) and not regexp_matches(s[instr(s, {o.q(n)}) + {len(n)}], '^[a-z0-9]$') then {o.q(n)}"
    for n, _, _, _ in sorted(place.gazetteer(), key=lambda g: (-g[3], -len(g[0].encode()), place.gazetteer().index(g)))
)


@query("place_text_best", f"select event_id, case {BEST} end as place from (select event_id, lower(sentence) as s from ({M}))")
def place_text_best(spark, sf_dir):
    return mentions(spark, sf_dir).select("event_id", place.best_in_text(F.col("sentence")).alias("place"))


@query("occurrence_dedup", f"{KEYS} select occurrence_key, min(event_id) as event_id, count(*) as support from k group by all")
def occurrence_dedup(spark, sf_dir):
    return assembly.reinforced(keyed(spark, sf_dir), "occurrence_key", "event_id").select("occurrence_key", "event_id", "support")


@query(
    "competing_places",
    f"{KEYS} select stem, string_agg(p, ',' order by p) as places, count(*)::int as n from (select distinct stem, {o.normal('place_label')} as p from k) where p <> '' group by stem having count(*) >= 2",
)
def competing_places(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("stem", text.normalize_surface(F.col("place_label")).alias("place"))
    return assembly.competing(rows, "stem", "place")


@query(
    "singleton_birth_death",
    f"""{KEYS}, r as (select person, event_type, event_id, year, row_number() over (partition by person, event_type order by event_id) as n from k where event_type in ('birth', 'death'))
    select person, event_type, event_id, year from r where n = 1""",
)
def singleton_birth_death(spark, sf_dir):
    rows = judged(spark, sf_dir).filter("verdict = 'accept' and event_type in ('birth', 'death')").select("person", "event_type", "event_id", "year")
    return assembly.first_writers(rows, ["person", "event_type"], ["event_id"])


AGE_BAD = "case event_type when 'birth' then false " + " ".join(f"when {o.q(t)} then not (age between {a} and {b})" for ts, a, b in rules.AGES for t in ts) + " else not (age between 0 and 120) end"
CODES = f"""list_filter([
    case when cross_clause then 'cross_clause_join' end, case when not has_evidence then 'missing_evidence' end, case when is_duplicate then 'duplicate_candidate' end,
    case when place_kind <> 'place' then 'invalid_place_kind' end, case when age < 0 and event_type <> 'birth' then 'event_before_subject_birth' end,
    case when age is not null and event_type <> 'birth' and {AGE_BAD} then 'implausible_age_for_event_type' end,
    case when year > death_year and (event_type <> 'death' or has_death) then 'event_after_subject_death' end,
    case when (event_type = 'birth' and has_birth) or (event_type = 'death' and has_death) then 'singleton_cardinality_violation' end], lambda x: x is not null)"""
GATED = f"""{KEYS}, g0 as (
    select event_id, person, event_type, year, event_id % 41 = 0 as cross_clause, event_id % 37 <> 0 as has_evidence,
           row_number() over (partition by occurrence_key order by event_id) > 1 as is_duplicate,
           case when place_label in ('his house', 'Nowhere') then 'unknown' else 'place' end as place_kind,
           case when user_id % 31 <> 0 then user_id end as subject_id,
           min(case when event_type = 'birth' then year end) over w as birth_year, min(case when event_type = 'death' then year end) over w as death_year
    from k window w as (partition by person order by event_id rows between unbounded preceding and 1 preceding)),
    g1 as (select *, year - birth_year as age, birth_year is not null as has_birth, death_year is not null as has_death from g0),
    g as (select *, {CODES} as codes from g1)"""


def gated(spark, sf_dir):
    # the candidates are a table: births and deaths are read from it again
    k = assembly.lifespans(written(keyed(spark, sf_dir), "candidates"), "person", "event_id")
    again = F.row_number().over(Window.partitionBy("occurrence_key").orderBy("event_id")) > 1
    k = k.withColumns(
        {
            "cross_clause": F.col("event_id") % 41 == 0,
            "has_evidence": F.col("event_id") % 37 != 0,
            "is_duplicate": again,
            "place_kind": F.when(F.col("place_label").isin("his house", "Nowhere"), "unknown").otherwise("place"),
            "subject_id": F.when(F.col("user_id") % 31 != 0, F.col("user_id")),
            "has_birth": F.col("birth_year").isNotNull(),
            "has_death": F.col("death_year").isNotNull(),
        }
    )
    return assembly.apply_gates(k)


@query(
    "gate_decisions",
    f"{GATED} select event_id, array_to_string(codes, ',') as codes, case when len(codes) > 0 then 'rejected' when year is null or subject_id is null then 'needs_review' else 'accepted' end as status from g",
)
def gate_decisions(spark, sf_dir):
    return gated(spark, sf_dir).select("event_id", F.array_join("rejection_codes", ",").alias("codes"), "status")


@query("rejection_histogram", f"{GATED} select code, count(*) as n from (select unnest(codes) as code from g) group by code")
def rejection_histogram(spark, sf_dir):
    return gated(spark, sf_dir).select(F.explode("rejection_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(
    "fingerprints",
    f"""{KEYS} select event_id, {o.joined("event_id::varchar", "person", "year::varchar", "place_label", "verb")} as combinator,
        {o.joined("'v1'", o.normal("person"), "event_type", "verb_label", "time_key", o.normal("place_label"), o.normal("page"), "'0'", "'0'", "length(sentence)::varchar", "person")} as candidate,
        {o.barred(o.normal("person"), "verb_label", o.normal("verb"), "time_key", o.normal("place_label"))} as claim from k""",
)
def fingerprints(spark, sf_dir):
    c, page = F.col, text.normalize_surface(F.col("page"))
    return keyed(spark, sf_dir).select(
        "event_id",
        ident.combinator_hash(c("event_id"), c("person"), c("year"), c("place_label"), c("verb")).alias("combinator"),
        ident.candidate_fingerprint(F.lit("v1"), c("person"), c("event_type"), c("verb_label"), c("time_key"), c("place_label"), page, F.lit(0), F.lit(0), F.length("sentence"), F.array("person")).alias("candidate"),
        ident.claim_fingerprint(c("person"), c("verb_label"), c("verb"), c("time_key"), c("place_label")).alias("claim"),
    )


@query(
    "carry_year_place",
    f"""{JUDGED} select event_id, page, last_value(year ignore nulls) over w as carry_year, last_value(case when map_eligible then place_label end ignore nulls) over w as carry_place
    from judged window w as (partition by page order by event_id rows between unbounded preceding and 1 preceding)""",
)
def carry_year_place(spark, sf_dir):
    rows = assembly.carried(judged(spark, sf_dir), "page", "event_id", carry_year=F.col("year"), carry_place=F.when(F.col("map_eligible"), F.col("place_label")))
    return rows.select("event_id", "page", "carry_year", "carry_place")


@query(
    "supersession_chain",
    f"{KEYS} select event_id, stem, lag(event_id) over w as supersedes, lead(event_id) over w as superseded_by from k window w as (partition by stem order by event_id)",
)
def supersession_chain(spark, sf_dir):
    return assembly.supersession(keyed(spark, sf_dir), "stem", "event_id", "event_id").select("event_id", "stem", "supersedes", "superseded_by")


@query(
    "timeline_events",
    f"{KEYS}, e as (select min(event_id) as event_id from k group by occurrence_key) select event_id, person, event_type, year, place_label, title from k join e using (event_id) order by year nulls last, event_id limit 2000",
)
def timeline_events(spark, sf_dir):
    """The first 2,000 events in time: the first writer of each occurrence, nulls last, ties by id."""
    row = F.struct("event_id", "person", "event_type", "year", "place_label", "title")
    firsts = keyed(spark, sf_dir).groupBy("occurrence_key").agg(F.min_by(row, "event_id").alias("first")).select("first.*")
    return firsts.orderBy(F.asc_nulls_last("year"), "event_id").limit(2000)


@query(
    "timeline_whole",
    f"{KEYS}, e as (select min(event_id) as event_id from k group by occurrence_key) select event_id, person, event_type, year, place_label, title from k join e using (event_id)",
)
def timeline_whole(spark, sf_dir):
    """All events of the timeline, without a limit or order: the first writer of each occurrence."""
    row = F.struct("event_id", "person", "event_type", "year", "place_label", "title")
    return keyed(spark, sf_dir).groupBy("occurrence_key").agg(F.min_by(row, "event_id").alias("first")).select("first.*")


@query("timeline_period", f"{JUDGED} select event_id, person, year, title from judged where lower(person) like '%person 1%' and (year is null or year between 1790 and 1815)")
def timeline_period(spark, sf_dir):
    """One period of the persons that match; rows without a year pass."""
    rows = judged(spark, sf_dir).filter(F.ilike("person", F.lit("%person 1%")) & (F.col("year").isNull() | F.col("year").between(1790, 1815)))
    return rows.select("event_id", "person", "year", "title")


@query(
    "geojson_points",
    f"""{JUDGED} select event_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lon * 10000)::bigint || ',' || round(lat * 10000)::bigint || ']}},"properties":{{"title":"' || title || '"}}}}' as feature from judged where map_eligible""",
)
def geojson_points(spark, sf_dir):
    """A feature for each event on the map, longitude first, in ten-thousandths of a degree."""
    deg = lambda c: F.round(F.col(c) * 10000).cast("long")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(deg("lon"), deg("lat")).alias("coordinates")).alias("geometry"),
        F.struct("title").alias("properties"),
    )
    return judged(spark, sf_dir).filter("map_eligible").select("event_id", F.to_json(feature).alias("feature"))


@query(
    "quality_report",
    f"""{GATED}, s as (select *, case when len(codes) > 0 then 'rejected' when year is null or subject_id is null then 'needs_review' else 'accepted' end as status from g)
    select count(*) as candidates, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'needs_review') as in_review,
           count(*) filter (event_type = 'birth' and status = 'accepted') as births, count(*) filter (list_contains(codes, 'duplicate_candidate')) as duplicates, count(distinct person) as persons from s""",
)
def quality_report(spark, sf_dir):
    """One pass over the candidates."""
    n = lambda test, name: F.count_if(test).alias(name)
    status = F.col("status")
    return gated(spark, sf_dir).agg(
        F.count("*").alias("candidates"), n(status == "accepted", "accepted"), n(status == "rejected", "rejected"), n(status == "needs_review", "in_review"),
        n((F.col("event_type") == "birth") & (status == "accepted"), "births"), n(F.array_contains("rejection_codes", "duplicate_candidate"), "duplicates"), F.countDistinct("person").alias("persons"),
    )


@query(
    "upsert_latest_wins",
    f"{JUDGED} select person, page, arg_max(place_label, event_id) as place_label, max(event_id) as event_id from judged group by all",
)
def upsert_latest_wins(spark, sf_dir):
    rows = judged(spark, sf_dir).select("person", "page", "place_label", "event_id")
    return assembly.last_writers(rows, ["person", "page"], ["event_id"])


@query(
    "insert_if_absent",
    f"""with m as ({M}), old as (select person, verb, min(event_id) as event_id from m where event_id % 3 = 0 group by all),
    new as (select person, verb, min(event_id) as event_id from m where event_id % 3 <> 0 group by all)
    select * from old union all select * from new where not exists (select 1 from old where old.person = new.person and old.verb = new.verb)""",
)
def insert_if_absent(spark, sf_dir):
    m = mentions(spark, sf_dir).select("person", "verb", "event_id")
    table = assembly.first_writers(m.filter("event_id % 3 = 0"), ["person", "verb"], ["event_id"])
    return assembly.insert_if_absent(table, m.filter("event_id % 3 <> 0"), ["person", "verb"], ["event_id"])


@query("person_search_score", f"""select event_id, case when {o.word_of("s", rules.PERSON_WORDS)} or {o.any_of("s", rules.PERSON_PARTS)} then 50 else 0 end
    - case when {o.any_of("s", rules.THING_PARTS)} then 70 else 0 end - case when {o.any_of("s", rules.PLACE_PARTS)} then 35 else 0 end as score
    from (select event_id, lower(sentence || case event_id % 5 when 0 then ' king' when 1 then ' album' when 2 then ' painter of a film located in Rome' else '' end) as s from ({M}))""")
def person_search_score(spark, sf_dir):
    n = F.col("event_id") % 5
    tail = F.when(n == 0, " king").when(n == 1, " album").when(n == 2, " painter of a film located in Rome").otherwise("")
    return mentions(spark, sf_dir).select("event_id", judges.person_score(F.concat("sentence", tail)).alias("score"))


STAGED = f"""{KEYS}, s0 as (select *, {o.normal("place_label")} as place from k),
    s1 as (select *, min(nullif(place, '')) over w as low, max(nullif(place, '')) over w as high,
                  list(nullif(place, '')) over (partition by stem order by event_id rows between unbounded preceding and current row) as seen
           from s0 window w as (partition by stem order by event_id rows between unbounded preceding and 1 preceding)),
    s2 as (select *, coalesce(place <> '' and (low <> place or high <> place), false) as competes from s1),
    s3 as (select *, first_value(event_id) over (partition by occurrence_key, competes order by event_id) as made,
                  first_value(event_id) over (partition by person, event_type, competes order by event_id) as only_one,
                  first_value(occurrence_key) over (partition by person, event_type, competes order by event_id) as only_key from s2),
    s4 as (select *, case when competes then null when event_type in ('birth', 'death') then case when occurrence_key = only_key then only_one end else made end as event from s3),
    staged as (select *, case when competes then 'needs_review' when event is null then 'rejected' when event = event_id then 'created' else 'reinforced' end as outcome,
                  case when competes then array_to_string(list_sort(list_distinct(list_filter(seen, lambda x: x is not null))), ',') end as places from s4),
    disputed as (select stem, max(event_id) as last from staged where competes group by stem)"""


def staged(spark, sf_dir):
    rows = with_keys(judged(spark, sf_dir)).withColumn("place", text.normalize_surface(F.coalesce("place_label", F.lit(""))))
    # judged once: the stage reads its candidates several times. Rejected ones are left out of the table and not before, as that filter would go below the judging, to where the file is read, and repeat it
    table = written(rows.select("event_id", "person", "event_type", "stem", "occurrence_key", "place", "status", "time_key", "year", "map_eligible", "verdict"), "staged")
    return stage.decide(table.filter("verdict = 'accept'").drop("verdict"))


@query(
    "event_stage",
    f"""{STAGED} select event_id, outcome, case when competes then 'competing_place' when outcome = 'rejected' then 'singleton_cardinality_violation' end as code, places, event from staged""",
)
def event_stage(spark, sf_dir):
    """What becomes of each accepted candidate: an event, its support, a competing reading, or a second birth."""
    return staged(spark, sf_dir).select("event_id", "outcome", "code", F.array_join("places", ",").alias("places"), "event")


@query(
    "event_table",
    f"""{STAGED}, e as (select occurrence_key, stem, min(event) as event_id, count(*) as support from staged where event is not null group by occurrence_key, stem)
    select occurrence_key, event_id, support, case when last > event_id then 'uncertain' else 'attested' end as status from e left join disputed using (stem)""",
)
def event_table(spark, sf_dir):
    """The events with their support; uncertain if a competing reading came later."""
    decided = written(staged(spark, sf_dir).select("event_id", "occurrence_key", "stem", "outcome", "event"), "decided")  # read twice
    return stage.event_table(decided).select("occurrence_key", "event_id", "support", "status")
