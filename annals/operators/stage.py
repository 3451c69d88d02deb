"""The event stage: accepted candidates become events, one after the other.

A candidate's stem is what happened without the place. A place that differs from one read before for
the same stem makes the candidate a competing reading: it goes to review and the events of the stem
turn uncertain. Readings without a place contradict nothing. Otherwise the candidate supports the
event of its occurrence key, or becomes it; of births and deaths a person has one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SINGLETONS = ["birth", "death"]
COMPETING, CARDINALITY = "competing_place", "singleton_cardinality_violation"


def readings(candidates: DataFrame) -> DataFrame:
    """By stem: its places with the first candidate of each, in that order, and the first candidate without a place. Map-side combined."""
    by_place = candidates.groupBy("stem", "place").agg(F.min("event_id").alias("first"))
    named = F.col("place") != ""
    return by_place.groupBy("stem").agg(
        F.array_sort(F.collect_list(F.when(named, F.struct("first", "place")))).alias("readings"), F.min(F.when(~named, F.col("first"))).alias("unplaced")
    )


def singleton(event_type: Column) -> Column:
    return event_type.isin(SINGLETONS)


def decide(candidates: DataFrame) -> DataFrame:
    """candidates (event_id, person, event_type, stem, occurrence_key, place: normal form, empty for none) in the order of event_id,
    with outcome (created, reinforced, needs_review, rejected), code, places (that compete) and event (the event_id that it supports).

    What a row has before it comes from sums by (stem, place), so no group is gathered and joins of hot stems can be split.
    The candidates are read four times: hand over a table.
    """
    rows = candidates.join(readings(candidates), "stem", "left")
    order, place = F.col("event_id"), F.col("place")
    first, rival = F.try_element_at("readings", F.lit(1)), F.try_element_at("readings", F.lit(2))
    other = F.when(first["place"] == place, rival["first"]).otherwise(first["first"])  # the first candidate with another place
    rows = rows.withColumn("competes", F.coalesce((place != "") & (other < order), F.lit(False)))
    made = F.when(place == "", F.col("unplaced")).otherwise(first["first"])
    calm = rows.filter(~F.col("competes") & singleton(F.col("event_type")))
    only = calm.groupBy("person", "event_type").agg(F.min("event_id").alias("only"), F.min_by("occurrence_key", "event_id").alias("only_key"))
    rows = rows.join(only, ["person", "event_type"], "left")
    event = F.when(singleton(F.col("event_type")), F.when(F.col("occurrence_key") == F.col("only_key"), F.col("only"))).otherwise(made)
    rows = rows.withColumn("event", F.when(~F.col("competes"), event))
    outcome = F.when(F.col("competes"), "needs_review").when(F.col("event").isNull(), "rejected").when(F.col("event") == order, "created").otherwise("reinforced")
    seen = F.filter("readings", lambda r: r["first"] <= order)["place"]
    rows = rows.withColumns({"outcome": outcome, "places": F.when(F.col("competes"), F.array_sort(seen))})
    code = F.when(F.col("competes"), COMPETING).when(F.col("outcome") == "rejected", CARDINALITY)
    return rows.withColumn("code", code).drop("readings", "unplaced", "competes", "only", "only_key")


def disputes(decided: DataFrame) -> DataFrame:
    """By stem: the last competing reading."""
    return decided.filter("outcome = 'needs_review'").groupBy("stem").agg(F.max("event_id").alias("disputed"))


def event_table(decided: DataFrame) -> DataFrame:
    """occurrence_key, stem, event_id, support, status of the events: uncertain if a competing reading came after them, else attested."""
    made = decided.filter("event is not null").groupBy("occurrence_key", "stem").agg(F.min("event").alias("event_id"), F.count("*").alias("support"))
    status = F.when(F.col("disputed") > F.col("event_id"), "uncertain").otherwise("attested")
    return made.join(disputes(decided), "stem", "left").withColumn("status", status).drop("disputed")
