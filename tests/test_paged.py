"""The paged source: any page size gives the documents once; a stream goes on from its cursor."""

import json

import pytest
from pyspark.sql import functions as F

from annals.sources.paged import PagedSource

CONNECTOR = "annals.sources.paged:LinesConnector"


@pytest.fixture()
def docs(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    at = tmp_path / "docs.jsonl"

    def put(first, last):
        with at.open("a") as f:
            f.writelines(json.dumps({"id": i, "title": f"T{i}"}) + "\n" for i in range(first, last))

    put(0, 23)
    return at, put


def options(reader, at, size):
    return reader.format("paged").option("connector", CONNECTOR).option("path", str(at)).option("page_size", size)


@pytest.mark.parametrize("size", [1, 7, 23, 1000])
def test_any_page_size_gives_the_table_once(spark, docs, size):
    rows = options(spark.read, docs[0], size).load()
    assert rows.rdd.getNumPartitions() == -(-23 // size)
    got = rows.select("cursor", F.get_json_object("payload", "$.id").cast("int").alias("id")).collect()
    assert sorted((r.cursor, r.id) for r in got) == [(i, i) for i in range(23)]


def test_a_stream_goes_on_from_its_cursor(spark, docs, tmp_path):
    at, put = docs
    out, point = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(size):
        q = options(spark.readStream, at, size).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.cursor for r in spark.read.parquet(out).collect())

    assert run(5) == list(range(23))
    assert run(5) == list(range(23))  # nothing new
    put(23, 31)
    assert run(4) == list(range(31))  # another page size goes on from the same cursor


def test_page_size_must_be_positive(spark, docs):
    with pytest.raises(Exception, match="page_size"):
        options(spark.read, docs[0], 0).load().collect()
