"""Queries over page titles derived from mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.operators import titles
from annals.plans import oracle as o
from annals.plans.synth import mentions, mentions_sql, values

QUERIES, SQL = {}, {}
M = mentions_sql()
KINDS = [
    "person", "'Battle of ' || place_surface", "'List of years ' || event_id", "cast(1700 + event_id % 300 as string)", "place_surface || ' University'", "'Category: ' || page", "'Treaty of ' || place_surface",
    "person || ' in literature'", "'18th century'", "upper(person)", "'On the road to the sea of sand'", "'Timeline of ' || person", "page",
]
TITLE = "case event_id % 13 " + " ".join(f"when {i} then {k}" for i, k in enumerate(KINDS)) + " end"
STARTS = lambda c, parts: "(" + " or ".join(f"starts_with({c}, {o.q(p)})" for p in parts) + ")"
ENDS = lambda c, parts: "(" + " or ".join(f"ends_with({c}, {o.q(p)})" for p in parts) + ")"
NOISE = f"""(strlen(t) not between 2 and 80 or {STARTS("low", titles.NOISE_STARTS)} or {ENDS("low", titles.NOISE_ENDS)} or {o.any_of("low", titles.NOISE_PARTS)} or b > 6 or contains(t, ':')
    or (contains(low, ' the ') and b > 3) or regexp_matches(t, '^[0-9]{{4}}$'))"""
T = f"t0 as (select event_id, person as subject, trim({TITLE}) as t from ({M})), t1 as (select *, lower(t) as low, length(t) - length(replace(t, ' ', '')) as b from t0)"


def rows(spark, sf_dir):
    return mentions(spark, sf_dir).selectExpr("event_id as seq", "person as subject", f"{TITLE} as title")


def noise_titles(spark, sf_dir):
    return rows(spark, sf_dir).groupBy(titles.is_noise(F.col("title")).alias("noise")).agg(F.count("*").alias("n"))


def seed_merge_rank(spark, sf_dir):
    return titles.merged_titles(rows(spark, sf_dir), 40)


LINKED = """sentence || case event_id % 4 when 0 then ' See Battle of ' || place_surface || ', the SIEGE OF ' || place_surface || ' (again) and the siege of Toulon.' when 1 then ' La bataille de Valmy; le Siège de ' || place_surface || '.'
    when 2 then ' Le traité de Lunéville, le traite de ' || place_surface else ' Nothing of the treaty of the king. Treaty of Amiens' end"""


def linked_titles(spark, sf_dir):
    """Titles that a text names, to be followed."""
    t = mentions(spark, sf_dir).selectExpr("event_id", f"{LINKED} as t")
    return t.select("event_id", F.array_join(titles.linked_titles(F.col("t")), "|").alias("titles"))


def linked_sql() -> str:
    from annals.plans.extracts import PLAUSIBLE

    good = f"strlen(place) between 2 and 60 and {PLAUSIBLE}"
    forms = ", ".join(f"({i}, {o.q(said)}, {o.q(head)})" for i, (said, head) in enumerate(titles.LINKED))
    return f"""with m as (select event_id, {LINKED} as t from ({mentions_sql()})), f as (select * from (values {forms}) as x(k, said, head)),
        p as (select event_id, k, head, unnest(regexp_split_to_array(t, '(?i)' || said)) as piece, generate_subscripts(regexp_split_to_array(t, '(?i)' || said), 1) as i from m cross join f),
        n as (select event_id, k, i, head, trim(regexp_extract(piece, '^[^.,;\n()]*')) as place from p where i > 1),
        g as (select event_id, string_agg(head || place, '|' order by k, i) as titles from n where {good} group by event_id)
        select event_id, coalesce(titles, '') as titles from m left join g using (event_id)"""


QUERIES |= {"noise_titles": noise_titles, "seed_merge_rank": seed_merge_rank, "linked_titles": linked_titles}
SQL |= {
    "linked_titles": linked_sql(),
    "noise_titles": f"with {T} select {NOISE} as noise, count(*) as n from t1 group by 1",
    "seed_merge_rank": f"""with {T}, g as (select subject, low, arg_min(t, event_id) as title from t1 where not {NOISE} group by all),
        r as (select subject, title, case when low = lower(subject) then 0 when contains(subject, ' ') and contains(low, lower(string_split(subject, ' ')[-1])) then 1
            when {STARTS("low", titles.VALUE_STARTS)} or {o.any_of("low", titles.VALUE_PARTS)} then 2 else 3 end as rank from g),
        p as (select *, (row_number() over (partition by subject order by rank, title))::int as place from r) select * from p where place <= 40""",
}


RANKED_TITLES = ["Battle of Jena", "Nobel prix", "Second World War", "Comics about a king", "Treaty of Paris", "Person 3", "Oeuvres and poems", "Siege of 1914", "Early life", "Liste des rois", "Université", "Opera in 1939"]
RANKED = f"""
    select e.event_id, t.title, 'Person ' || cast(e.user_id % 61 as string) as subject, case when e.user_id % 5 = 0 then null else 1750 + e.user_id % 200 end as death_year, e.user_id % 3 = 0 as military,
           c.cls as first_class, case when e.event_id % 4 = 0 then d.cls end as second_class from {{events}} e
    join {values(RANKED_TITLES, "t", "k", "title")} on t.k = e.event_id % {len(RANKED_TITLES)}
    join {values([p[0] for p in rules.PROFILES], "c", "k", "cls")} on c.k = e.user_id % {len(rules.PROFILES)}
    join {values([p[0] for p in rules.PROFILES], "d", "k", "cls")} on d.k = (e.user_id * 3 + 1) % {len(rules.PROFILES)}"""
RANK_SQL = "case when {against} and not (military and b) then 15 else greatest(0, least(100, 40 + case when {for_} then 40 else 0 end + case when military and b then 30 else 0 end - case when death_year < 1900 and w then 50 else 0 end)) end"
RANK_OF = lambda cls: f"case {cls} " + " ".join(f"when '{c}' then " + RANK_SQL.format(against=o.any_of("low", minus), for_=o.any_of("low", plus)) for c, _, plus, minus in rules.PROFILES) + " end"


SQL["title_rank"] = f"""with r as (select *, lower(title) as low from ({RANKED.format(events="events")})), r1 as (select *, {o.any_of("low", rules.BATTLE_TITLES)} as b, {o.any_of("low", rules.LATE_WARS)} as w from r),
    r2 as (select *, greatest({RANK_OF("first_class")}, coalesce({RANK_OF("second_class")}, 0)) as rank from r1)
    select event_id, title, rank, lower(title) = lower(subject) or rank >= 55 as kept from r2"""


def title_rank(spark, sf_dir):
    """Pages that go with a person of one or two classes."""
    rows = spark.sql(RANKED, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    rank = titles.title_rank(F.col("title"), F.array_compact(F.array("first_class", "second_class")), F.col("death_year"), F.col("military"))
    rows = rows.withColumn("rank", rank)
    return rows.select("event_id", "title", "rank", titles.keeps_title(F.col("title"), F.col("subject"), F.col("rank")).alias("kept"))


QUERIES["title_rank"] = title_rank
