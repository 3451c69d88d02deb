import hashlib
import random

import pytest
from pyspark.sql import functions as F

from annals.llm.exact_dedup import RUN, dedup, digests, exact_dedup, merger, tree_merge


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def make(spark):
    rnd = random.Random(6)
    texts = ["One", "one", "ONE é", "one É", "two", None, "", "x" * 50000]
    rows = [(i, rnd.choice(texts)) for i in range(200)] + [(1000 + i, f"own {i}") for i in range(20)] + [(199, "one"), (None, "only null"), (None, "one"), (1019, "own 19"), (1019, "own 19")]
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, digest string, keep_id int").repartition(7), rows


@pytest.mark.parametrize("keep", ["max", "min"])
def test_matches_brute_force(spark, keep):
    docs, rows = make(spark)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = {t: (max if keep == "max" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, keep).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = dedup(docs, keep)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, lower(r.text)) for r in kept.collect()), key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)


def test_any_number_of_rounds(spark):
    docs, _ = make(spark)
    rows = digests(docs)
    want = sorted(map(tuple, tree_merge(rows, node_bits=1, radix_bits=1).collect()))
    for node_bits, radix_bits in ((5, 2), (8, 8)):
        assert sorted(map(tuple, tree_merge(rows, node_bits=node_bits, radix_bits=radix_bits).collect())) == want


def test_runs_are_sorted_and_merged(spark):
    """The plan sorts and merges in every round, and with half of all rows equal no merge sees more than the runs' entries."""
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'same', concat('own ', id)) as text").repartition(16, "doc_id")
    rows = digests(docs).cache()
    plan = tree_merge(rows, node_bits=4, radix_bits=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Sort [") == 3
    hot = F.sha2(F.lit("same"), 256)
    at = {"entries": spark.sparkContext.accumulator(0)}

    def counting(batches):
        for b in batches:
            at["entries"].add(b.num_rows)
            yield b

    runs = rows.withColumn("node", F.spark_partition_id().cast("long")).filter(F.col("digest") == hot)
    runs = runs.select("node", "digest", "check", "length", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    runs.sortWithinPartitions("node").mapInArrow(merger("max"), RUN.format(id="bigint")).mapInArrow(counting, RUN.format(id="bigint")).count()
    assert at["entries"].value <= 16  # an entry from each partition, of 2000 rows
    (group,) = tree_merge(rows, node_bits=4, radix_bits=2).filter(F.col("digest") == hot).collect()
    assert (group.group_size, group.keep_id) == (2000, 3998)


def test_frequent_digests_travel_and_others_join(spark):
    docs, _ = make(spark)
    want = sorted(map(tuple, exact_dedup(docs, hot=1).collect()), key=repr)
    for hot in (4, 10**6):
        assert sorted(map(tuple, exact_dedup(docs, hot=hot).collect()), key=repr) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(none).count() == 0 and dedup(none).count() == 0
