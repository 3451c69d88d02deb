"""Mentions derived from the events table in SQL that Spark and DuckDB both run: each event becomes a sentence
about a person, with a verb, a place and a time, some of them missing, odd or doubtful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERBS = [
    ("born", "was born"), ("died", "died"), ("married", "married"), ("studied", "studied"), ("fought", "fought at the battle of"), ("signed", "signed the treaty of"),
    ("visited", "visited"), ("exiled", "was exiled"), ("crowned", "was crowned"), ("published", "published a theory"), ("", "was seen"), ("associated", "is said to have stayed"),
    ("unveiled", "has a statue"), ("re-elected", "was re-elected"), ("anecdote", "told a story"), ("met", "met with friends"),
    ("died", "mourned when the daughter died"), ("", "heard of the king's death"), ("died", "lost a person, and the wife wept; Person 7 died"),
]
PLACES = ["Paris", "London", "Saint Helena", "Elba", "Waterloo.", "Rome", "Egypt", "Notre-Dame", "his house", "Nowhere", "New York", "Amiens", "", "The Coalition"]
CUES = ["", "", " reportedly", " perhaps", " around noon", ", historians debate,", "", " during the war"]


def values(rows: list, *names: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    body = ", ".join(f"({i}, {', '.join(map(quote, r if isinstance(r, tuple) else (r,)))})" for i, r in enumerate(rows))
    return f"(values {body}) as {names[0]}({', '.join(names[1:])})"


# Each seventh event is one of a few reports of what its person did in a year: same verb, same year, places that differ or not.
SHARED = "event_id % 7 = 3"
MENTIONS = f"""
    select e.event_id, e.user_id, e.event_type as channel, 'Person ' || cast(e.user_id as string) as person, 'Page ' || cast(e.user_id as string) as page,
           v.verb, p.place as place_surface,
           case when {SHARED} then cast(e.y as string) when e.event_id % 23 = 0 then '' when e.event_id % 19 = 0 then cast(e.event_id % 900 + 1 as string) || ' BC'
                when e.event_id % 17 = 0 then 'c. ' || cast(e.y as string) || '.' when e.event_id % 29 = 0 then '123456'
                else cast(e.y as string) end as time_surface,
           'Person ' || cast(e.user_id as string) || ' ' || v.phrase || ' in ' || p.place || c.cue || ' in ' || cast(e.y as string) || '.' as sentence
    from (
        select event_id, user_id, event_type,
               case when {SHARED} then 1790 + user_id % 40 + cast(floor(event_id / 7) as bigint) % 4 else 1750 + event_id % 120 end as y,
               case when {SHARED} then user_id else event_id end % {len(VERBS)} as vk,
               case when {SHARED} then user_id + cast(floor(event_id / 28) as bigint) % 5 else event_id * 7 + user_id end % {len(PLACES)} as pk,
               (event_id * 3 + user_id) % {len(CUES)} as ck
        from {{events}}) e
    join {values(VERBS, "v", "k", "verb", "phrase")} on v.k = e.vk
    join {values(PLACES, "p", "k", "place")} on p.k = e.pk
    join {values(CUES, "c", "k", "cue")} on c.k = e.ck"""


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt out by number before the work on them: they are few bytes and much work, and a file may have few splits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MENTIONS, events=dealt(spark, sf_dir))


def mentions_sql() -> str:
    return MENTIONS.format(events="events")
