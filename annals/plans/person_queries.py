"""Queries over persons derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.operators import persons
from annals.plans import oracle as o
from annals.plans.synth import mentions, mentions_sql

QUERIES, SQL = {}, {}
M = mentions_sql()
JOBS = ["French physicist", "Inventeur", "poet and soldier", "a painter", "nobody", "Queen of the hills", "general", "pope", "runner, champion", "reformer", "politician", "thinker", "navigateur", "composer"]
JOB = "case (event_id * 5 + user_id) % 97 " + " ".join(f"when {i * 7} then '{j}'" for i, j in enumerate(JOBS)) + " else 'clerk' end"
CLASS = "case " + " ".join(f"when {o.any_of('low', parts)} then '{c}'" for parts, c in persons.CLASSES) + " end"
FOUND = f"m as ({M}), f as (select person, list(distinct {CLASS}) as found from (select person, lower({JOB}) as low from m) group by person), c as (select person, list_filter({persons.ORDER!r}, lambda x: list_contains(found, x)) as classes from f)"


def person_rows(spark, sf_dir):
    return persons.person_classes(mentions(spark, sf_dir).selectExpr("person", f"{JOB} as occupation"))


def person_class_list(spark, sf_dir):
    return person_rows(spark, sf_dir).select("person", F.array_join("classes", ",").alias("classes"), "primary", "military")


def military_kept(spark, sf_dir):
    m = mentions(spark, sf_dir).selectExpr("event_id", "person", "sentence", "case event_id % 3 when 0 then 'battle' when 1 then 'siege' else 'birth' end as event_type")
    rows = m.join(person_rows(spark, sf_dir).select("person", "military"), "person")
    return rows.select("event_id", persons.keeps_military(F.col("event_type"), F.col("military"), F.col("sentence"), F.col("person")).alias("kept"))


QUERIES |= {"person_class_list": person_class_list, "military_kept": military_kept}
SQL |= {
    "person_class_list": f"with {FOUND} select person, array_to_string(classes, ',') as classes, coalesce(classes[1], 'unknown') as \"primary\", list_contains(classes, 'military_leader') as military from c",
    "military_kept": f"""with {FOUND} select event_id, case event_id % 3 when 0 then 'battle' when 1 then 'siege' else 'birth' end not in ({", ".join(map(o.q, persons.MILITARY_TYPES))})
        or list_contains(classes, 'military_leader') or (contains(lower(sentence), 'person') and {o.any_of("lower(sentence)", persons.SERVICE)}) as kept from m join c using (person)""",
}
