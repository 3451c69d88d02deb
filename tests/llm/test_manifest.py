"""The Merkle manifest against a plain one."""

import hashlib
import zlib

from annals.llm.manifest import manifest_proofs, ranked

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, digest string, part int, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4].translate({c: c + 32 for c in range(65, 91)}) if lower and row[4] is not None else row[4]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def segments(tree, i):
    for level in tree[:-1]:
        s = i // 16 * 16
        yield level[s:i], level[i + 1 : s + 16]
        i //= 16


def plain(rows):
    """(doc_id, leaf) -> the rest, from rows of doc_id, source, lang, n_chars, text."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            path = [*segments(trees[s], i), *segments(top, k)]
            folded = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in path for x in (*left, *right)])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def proofs(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in manifest_proofs(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_hot_source_lone_last_nodes_and_many_sources(spark):
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(273)]  # 16 * 17 + 1: a lone last node on two levels
    rows += [(1000 + i, f"s{i}é", None, None, "T" * i) for i in range(18)]  # sources of one leaf, more than a node of them
    rows += [(2000 + i, None, "de", 1, None if i % 2 else "") for i in range(17)]
    assert proofs(spark, rows) == plain(rows)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(7, "a", "en", 1, "Same"), (7, "a", "en", 1, "Same"), (7, "a", "en", 1, "Other"), (None, "a", None, None, None), (None, "a", None, None, "X")]
    rows += [(9, "b", "en", 1, "A" * 300_000)] * 40  # equal nodes
    assert proofs(spark, rows) == plain(rows)


def test_one_leaf_and_none(spark):
    assert proofs(spark, [(5, "a", "en", 1, "Some")]) == plain([(5, "a", "en", 1, "Some")])
    assert proofs(spark, []) == []


def test_tampering_is_seen_only_where_the_text_changes(spark):
    rows = [(i, "a", "en", 1, "UPPER" if i % 2 else "lower") for i in range(60)]
    seen = {r[0]: r[-1] for r in proofs(spark, rows)}
    assert all(ok == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 5 > 0) for i, ok in seen.items()) and len(set(seen.values())) == 2


def test_requests_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"Text {i}", "x", 1, "y") for i in range(900)], SCHEMA)
    out = manifest_proofs(docs)
    assert len(out.collect()) == 900
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()  # as many as a 16th of the rows, each with its path


def test_bounds_of_ranges_are_sampled_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.lit("=a").alias("grp"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    asked, deal = [], type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, *a: (asked.append(a[0]), deal(self, *a))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = ranked(rows.repartition(3), ["doc_id", "digest"], "ranked")
        assert got.filter("idx <> doc_id or n <> 100000").count() == 0 and got.count() == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert asked == [4]  # 100 sampled rows a range and more go to the driver
