"""Assembly of candidates into events: gates, first writers, singletons, lifespans, conflicts, carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules


def implausible_age(event_type: Column, age: Column) -> Column:
    out = None
    for types, low, high in rules.AGES:
        test, bad = event_type.isin(types), ~age.between(low, high)
        out = F.when(test, bad) if out is None else out.when(test, bad)
    return F.when(event_type == "birth", False).otherwise(out.otherwise(~age.between(0, 120)))


def gate_codes() -> Column:
    """Rejection codes of a row, in order and each once, from: cross_clause, has_evidence, is_duplicate, place_kind, event_type,
    year, birth_year, death_year, has_birth, has_death. Null years pass."""
    c = F.col
    kind, age = c("event_type"), c("year") - c("birth_year")
    tests = [
        ("cross_clause_join", c("cross_clause")),
        ("missing_evidence", ~c("has_evidence")),
        ("duplicate_candidate", c("is_duplicate")),
        ("invalid_place_kind", c("place_kind") != "place"),
        ("event_before_subject_birth", (age < 0) & (kind != "birth")),
        ("implausible_age_for_event_type", (kind != "birth") & implausible_age(kind, age)),
        ("event_after_subject_death", (c("year") > c("death_year")) & ((kind != "death") | c("has_death"))),
        ("singleton_cardinality_violation", ((kind == "birth") & c("has_birth")) | ((kind == "death") & c("has_death"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests]))


def apply_gates(candidates: DataFrame) -> DataFrame:
    """Adds rejection_codes and status: rejected, needs_review (no year or no subject_id) or accepted."""
    c = candidates.withColumn("rejection_codes", gate_codes())
    review = F.col("year").isNull() | F.col("subject_id").isNull()
    return c.withColumn("status", F.when(F.size("rejection_codes") > 0, "rejected").when(review, "needs_review").otherwise("accepted"))


def first_writers(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_writers(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert."""
    return first_writers(rows, keys, [F.desc(c) for c in order])


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """table and the first new row of each key that it doesn't have."""
    fresh = first_writers(new, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def reinforced(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key and how many rows it has: support. Map-side combined."""
    return rows.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("support"))


def competing(rows: DataFrame, stem: str, place: str) -> DataFrame:
    """stem, places, n: the distinct places, sorted, of stems with at least two. Empty places are no reading."""
    found = rows.filter(F.col(place) != "").groupBy(stem).agg(F.sort_array(F.collect_set(place)).alias("places"))
    return found.filter(F.size("places") >= 2).select(stem, F.array_join("places", ",").alias("places"), F.size("places").alias("n"))


def lifespans(events: DataFrame, subject: str, order: str) -> DataFrame:
    """Adds birth_year and death_year of the subject as known before each row, from earlier births and deaths: the least years.

    Only births and deaths meet by subject, and only those below all earlier ones are kept (no more than there are
    years), as one short array for each subject; other rows join it, so a subject of very many rows can be split.
    """
    out = events
    for kind in ("birth", "death"):
        w = Window.partitionBy(subject).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = events.filter((F.col("event_type") == kind) & F.col("year").isNotNull()).select(subject, order, "year")
        new = rows.withColumn("_least", F.min("year").over(w)).filter("_least is null or year < _least")
        steps = new.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(order, "year"))).alias("_steps"))
        before = F.filter("_steps", lambda x: x[order] < F.col(order))
        out = out.join(steps, subject, "left").withColumn(f"{kind}_year", F.try_element_at(before, F.lit(-1))["year"]).drop("_steps")
    return out


def carried(rows: DataFrame, keys: str | list[str], order: str, **values: Column) -> DataFrame:
    """Adds for each name the last value that isn't null of the rows before with the same keys: a page, or a page and its section.

    A page's rows are sorted in one task, which spills; a page is a document and no group of unbounded size.
    """
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in values.items()})


def supersession(rows: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """Adds supersedes and superseded_by along the versions of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({"supersedes": F.lag(ident).over(w), "superseded_by": F.lead(ident).over(w)})


def context_band(rows: DataFrame, evidence: DataFrame, page: str, order: str, width: int = 2) -> DataFrame:
    """Rows within ``width`` places of an evidence row on the same page, with is_evidence. Offsets are exploded, so the join is on equal keys."""
    near = evidence.select(page, F.explode(F.sequence(F.col(order) - width, F.col(order) + width)).alias(order), (F.lit(0)).alias("_z")).distinct().drop("_z")
    marked = evidence.select(page, order).distinct().withColumn("_hit", F.lit(True))
    return rows.join(near, [page, order], "left_semi").join(marked, [page, order], "left").withColumn("is_evidence", F.coalesce("_hit", F.lit(False))).drop("_hit")
