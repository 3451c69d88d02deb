import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from annals.llm.common import alnum_words
from annals.llm.decontaminate import Search, block_tables, contamination, find_benchmark, keep_clean, searcher


def brute(text, items, window):
    ws, hit, names = alnum_words(text), set(), set()
    for item, t in items:
        p = alnum_words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for k in range(len(ws) - m + 1):
                if ws[k : k + m] == p[i : i + m]:
                    hit |= set(range(k, k + m))
                    names |= {str(item)} if item is not None else set()
    return len(ws), len(hit), sorted(names), hit


SMALL = st.lists(st.sampled_from(["a", "B", "c", "d,", "é"]), max_size=30).map(" ".join)


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), SMALL), max_size=5), st.lists(SMALL, max_size=5))
@settings(max_examples=150, deadline=None)
def test_search_matches_brute_force(items, texts):
    found, names = Search(items, 4).run([alnum_words(t) for t in texts])
    for t, f, n in zip(texts, found, names, strict=True):
        w = brute(t, items, 4)
        assert (set(np.flatnonzero(f).tolist()) if f is not None else set()) == w[3]
        assert sorted(n) == w[2]


def rows(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["on", "the", "of", "Ünder", "x1", "sea"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 11, 14])))) for i in range(30)] + [(40, None), (41, ""), (42, "..."), (3, "sea sea sea"), (None, "of of of on")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    docs += [(50, items[1][1].upper()), (51, None), (52, ""), (53, "?? !"), (54, ("the sea " * 40000) + items[2][1]), (50, "on")]
    return docs, items


def test_tables_with_nulls_and_clashing_names(spark):
    docs, items = rows(spark)
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for block_bytes in (8 << 20, 400):  # one block, several blocks
        got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in find_benchmark(d, b, 4, block_bytes).collect())
        assert got == sorted((i, *brute(t, items, 4)[:3]) for i, t in docs)
        clean = keep_clean(d, b, 4, block_bytes)
        assert clean.columns == d.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not brute(t, items, 4)[1])


def test_tables_are_built_once_a_block(spark):
    """Five blocks: five tables are built, in tasks, and a worker unpacks each once, over six slices of text."""
    docs, items = rows(spark)
    b = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    size = sum(len((t or "").encode()) for _, t in items)
    n, built = block_tables(b, 4, -(-size // 5))
    assert n == 5 and built.count() == 5
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in docs[:6]]
    loads = []

    class Sent:
        def __init__(self, data):
            self.data = data

        @property
        def value(self):
            loads.append(1)
            return self.data

    hit = [set() for _ in batches]
    for r in built.collect():
        for i, out in enumerate(searcher(f"t{r.block}", Sent(bytes(r.tables)), ["doc_id"])(iter(batches))):
            hit[i] |= {w for a, z in out.column("hit_words").to_pylist()[0] for w in range(a, z)}
    assert len(loads) == 5
    assert hit == [brute(t, [(str(i), x) for i, x in items], 4)[3] for _, t in docs[:6]]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(d, b).collect()] == [0]
    assert contamination(d.limit(0), b).count() == 0


def test_a_kept_document_brings_its_text_once(spark, monkeypatch):
    from annals.llm import decontaminate

    sent, real = [], decontaminate.searched
    monkeypatch.setattr(decontaminate, "searched", lambda rows, *a, **k: sent.append(rows.columns) or real(rows, *a, **k))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([("i", "b c d")], "item_id string, text string")
    kept = decontaminate.keep_clean(docs, benchmark, window=3)
    assert kept.columns == docs.columns and sorted(kept.collect()) == [(2, "x y"), (3, None)]
    assert [c for c in sent[0] if "text" in c] == ["_d_text"]
