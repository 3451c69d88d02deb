"""Metrics of a run, gathered in the pass that writes its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

OUTCOMES = ["created", "reinforced", "needs_review", "rejected"]


def loss_reasons(decided: DataFrame) -> DataFrame:
    """One row: candidates, a count for each outcome, accepted (created and reinforced) and losses, a map of reason to count. Two small aggregates."""
    by = decided.groupBy("outcome", "code").agg(F.count("*").alias("n"))
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome").isin(o), F.col("n"))), F.lit(0)).cast("long")
    reasons = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n"))))  # one entry a reason and outcome
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), *[n([o]).alias(o) for o in OUTCOMES], n(OUTCOMES[:2]).alias("accepted"), F.map_from_entries(reasons).alias("losses")
    )


def observed(decided: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """decided, and what becomes known of it when it is written: rows, the outcomes, and losses by each code that the stage gives."""
    from annals.operators.stage import CARDINALITY, COMPETING

    o = Observation(name)
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES] + [F.count_if(F.col("code").eqNullSafe(c)).alias(c) for c in (COMPETING, CARDINALITY)]
    return decided.observe(o, F.count("*").alias("candidates"), *counts), o
