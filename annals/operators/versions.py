"""Tables that are changed without being rewritten: a base and change files with versions, merged when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merged(base: DataFrame, changes: DataFrame, key: str, frozen: tuple[str, str] | None = None, first_known: dict[str, str] | None = None) -> DataFrame:
    """base with the changes applied, one row for each key.

    changes: key, version (above 0) and some columns of base; a null leaves the column as it is, a key
    that base doesn't have is a new row. Of each column the newest change wins. ``frozen`` (column,
    value): once a row has that value, later changes are refused. ``first_known`` (column: value of
    the unknown): such a column keeps the first value that is known. One shuffle by key; versions of a
    key must differ.
    """
    columns = [c for c in base.columns if c not in (key, "version")]
    start = base.withColumn("version", F.lit(0).cast("long")) if "version" not in base.columns else base
    rows = start.unionByName(changes.withColumn("version", F.col("version").cast("long")), allowMissingColumns=True)
    if frozen:
        name, value = frozen
        shut = F.min(F.when(F.col(name) == value, F.col("version"))).over(Window.partitionBy(key))
        rows = rows.withColumn("_shut", shut).filter(F.col("_shut").isNull() | (F.col("version") <= F.col("_shut"))).drop("_shut")

    def one(name: str) -> Column:
        unknown = (first_known or {}).get(name)
        version = lambda test: F.when(test, F.col("version"))
        newest = F.max_by(name, version(F.col(name).isNotNull()))
        return newest if unknown is None else F.coalesce(F.min_by(name, version(F.col(name) != unknown)), newest)

    return rows.groupBy(key).agg(*[one(c).alias(c) for c in columns])


class VersionedTable:
    """A folder with base/v=n and changes/v=n. Reading merges the newest whole base with the changes after it."""

    def __init__(self, spark: SparkSession, path: str, key: str, frozen: tuple[str, str] | None = None, first_known: dict[str, str] | None = None):
        self.spark, self.path, self.key, self.frozen, self.first_known = spark, path.rstrip("/"), key, frozen, first_known

    def _versions(self, part: str) -> list[int]:
        """The versions that were written whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if done(s.getPath()))

    def create(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/base/v=0")

    def change(self, rows: DataFrame, version: int) -> None:
        """Write the changes of a version. A version that is written again is replaced, so a job that is run again changes nothing."""
        have = self._versions("base")
        if version <= (have[-1] if have else 0):
            raise ValueError(f"version {version} is already in the base")
        rows.drop("version").write.mode("overwrite").parquet(f"{self.path}/changes/v={version}")

    def read(self) -> DataFrame:
        base = self._versions("base")[-1]
        out = self.spark.read.parquet(f"{self.path}/base/v={base}")
        later = [v for v in self._versions("changes") if v > base]
        if not later:
            return out
        parts = [self.spark.read.parquet(f"{self.path}/changes/v={v}").withColumn("version", F.lit(v - base)) for v in later]
        changes = parts[0]
        for p in parts[1:]:
            changes = changes.unionByName(p, allowMissingColumns=True)
        return merged(out, changes, self.key, self.frozen, self.first_known)

    def compact(self) -> None:
        """Write what is read now as the base of the newest version; readers go on with the old one until it is whole."""
        newest = max([*self._versions("changes"), *self._versions("base")])
        if newest > self._versions("base")[-1]:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base/v={newest}")
