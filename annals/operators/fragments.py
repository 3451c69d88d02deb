"""Fragments and facts: a cheap score that decides which sentences are worth extracting, and debates over conflicting readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import has_any
from annals.functions.text import slug

# Fixed values.
EXTRA_VERBS = ["discovered", "published", "publia", "publié", "parut", "studied", "visited", "lived", "vécut", "habita", "resided"]
PLACES = [
    "paris", "london", "ajaccio", "waterloo", "leipzig", "austerlitz", "elba", "saint helena", "st helena", "corsica", "moscow", "vienna", "rome", "milan", "toulon",
    "fontainebleau", "malmaison", "brienne", "egypt", "cairo", "jena", "wagram", "borodino", "smolensk", "tilsit", "notre-dame", "notre dame", "amiens",
]
YEAR = r"(^|[^0-9])([0-9]{1,4}\s*(bc|b\.c|av\.? j)|(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|1[0-9]{3}|20[0-9]{2}|2100)([^0-9]|$))"
AFTER_CUE = r"( in | at | to | on | near )[^\p{L}.;,0-9]*\p{L}[^.;,0-9]"
PERSON = r"(^|\s)[^\p{L}\s-]*\p{Lu}"


def verb_parts() -> list[str]:
    return [p for r in rules.PREDICATES for p in r[0]] + EXTRA_VERBS




def fragment_score(text: Column) -> Column:
    """Hundredths: year 30, verb 30, place 25, and 15 if a year and a place come with a name. Texts without letters get 0."""
    low = F.lower(text)
    year, verb = low.rlike(YEAR), has_any(low, verb_parts())
    place = low.rlike("(^|[^a-z0-9])(" + "|".join(PLACES) + ")([^a-z0-9]|$)") | low.rlike(AFTER_CUE)
    z = lambda test, n: F.when(test, n).otherwise(0)
    total = z(year, 30) + z(verb, 30) + z(place, 25) + z(year & place & text.rlike(PERSON), 15)
    return F.when(text.rlike(r"\p{L}"), total).otherwise(0)


def place_debates(readings: DataFrame) -> DataFrame:
    """readings: stem, person, event_type, time_key, place. One fact per place of each stem with at least two places:
    debate_id, question, proposition, category, fingerprint."""
    places = readings.filter("place <> ''").groupBy("stem", "person", "event_type", "time_key").agg(F.collect_set("place").alias("places")).filter("size(places) >= 2")
    rows = places.select("person", "event_type", "time_key", F.explode("places").alias("place"))
    question = F.concat(F.lit("Where was "), "person", F.lit(" during "), "event_type", F.lit(" ("), "time_key", F.lit(")?"))
    ident = F.concat_ws(":", F.lit("debate"), slug(F.concat_ws("-", F.lit("where"), "person", "event_type", "time_key")), slug(F.concat(F.lit("at-"), "place")))
    body = F.to_json(F.struct(F.lit("place_conflict").alias("kind"), F.col("place").alias("proposition"), question.alias("question"), F.lit("2").alias("version")))
    return rows.select(ident.alias("debate_id"), question.alias("question"), F.col("place").alias("proposition"), F.col("event_type").alias("category"), F.sha2(body, 256).alias("fingerprint"))


def merge_found(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and those of second whose key first doesn't have; one row for each key."""
    return first.dropDuplicates([key]).unionByName(second.dropDuplicates([key]).join(first.select(key), key, "left_anti"))
