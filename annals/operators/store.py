"""Writes that keep a Parquet folder's rules: children are replaced by parent, unchanged rows are skipped, ids are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of new whose key is unknown to old or whose content hash differs from it."""
    digest = lambda c: F.sha2(F.encode(F.coalesce(c, F.lit("")), "utf-8"), 256)
    have = old.select(key, digest(F.col(content)).alias("_h"))
    return new.withColumn("_h", digest(F.col(content))).join(have, [key, "_h"], "left_anti").drop("_h")


def replace_children(children: DataFrame, path: str, parent: str) -> None:
    """Write children to path, partitioned by parent: partitions of the parents that are written are replaced, others stay."""
    children.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str], have: DataFrame | None) -> DataFrame:
    """Append the rows whose keys aren't in have, each key once; returns what was appended."""
    fresh = rows.dropDuplicates(keys)
    if have is not None:
        fresh = fresh.join(have.select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh
