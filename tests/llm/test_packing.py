import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annals.llm.packing import first_fit_decreasing, pack_documents, pack_group
from annals.llm.tokens import Encoder, default_path


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=100, deadline=None)
def test_first_fit_matches_a_plain_scan(sizes):
    bins, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, free in enumerate(bins) if free >= sizes[i]), len(bins))
        if b == len(bins):
            bins.append(50)
        bins[b] -= sizes[i]
        want[i] = b
    assert first_fit_decreasing(sizes, 50) == want


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_every_id_lies_in_one_piece(lengths):
    seen, padding = defaultdict(list), 0
    for s in pack_group(lengths, 2048):
        fill = sum(p[2] for p in s)
        assert 0 < fill <= 2048 and all(p[2] > 0 for p in s)
        padding += 0 if fill & (fill - 1) == 0 else 2048 - fill
        for doc, start, n in s:
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == n
    assert padding <= 16 * max(1, sum(lengths) // 1024)


def test_pieces_of_a_table(spark):
    enc = Encoder(default_path())
    rows = [(1, "the end."), (2, None), (3, ""), (None, "x y"), (1, "the end."), (7, "wide " * 9000)] + [(i, f"text {i} " * (i % 90)) for i in range(10, 300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = pack_documents(docs, group_bytes=20000, ids=True).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i, np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces, place = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        place[r.sequence_id].append((r.offset, r.length))
    for i in {i for i, _ in rows} - {1}:
        whole = b"".join(x for _, x in sorted(pieces[i]))
        assert want[i, whole] == 1
    for p in place.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(k[1]) // 4 * n for k, n in want.items())


def test_repeated_rows_spread_over_groups(spark):
    """Half of all rows repeat one doc_id and text; no group holds more than its share of them."""
    docs = spark.range(600).selectExpr("if(id % 2 = 0, -1, id) as doc_id", "if(id % 2 = 0, 'the same words again and again', concat('own ', id)) as text").repartition(4)
    got = pack_documents(docs, group_bytes=2000, capacity=64)
    assert got.filter("doc_id = -1 and start = 0").count() == 300
    by_group = got.filter("doc_id = -1").groupBy((F.col("sequence_id") / (1 << 24)).cast("int")).agg(F.countDistinct("sequence_id", "offset").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert by_group[0] < 120 and by_group[1] > 3


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
