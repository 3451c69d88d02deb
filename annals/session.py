"""The session that annals runs in, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the folder in spark.checkpoint.dir and read back; on one machine without the setting to a temporary folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="annals-")
    path = f"{folder.rstrip('/')}/annals/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, unless their Python path has it already."""
    on_path = [os.path.realpath(p) for p in (os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]) if p]
    app = spark.sparkContext.applicationId
    if str(ROOT) in on_path or app in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp(prefix="annals-")) / "annals.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in [*(ROOT / "annals").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
            if f.exists():
                z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
