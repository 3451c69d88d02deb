"""Runs by grammar compression against all periods tried one by one."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from annals.llm.common import table
from annals.llm.queries import op11_periodic_runs, planted_period
from annals.llm.runs import Grammar, find_runs, periodic_runs, stretches


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # periods ascend, so the smallest stays
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(words):
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *numbers, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


block = st.builds(lambda u, k, cut: (u * k)[: max(1, len(u) * k - cut)], st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.builds(lambda bs, k: sum(bs, []) * k, st.lists(block, min_size=1, max_size=4), st.integers(1, 5)), min_size=1, max_size=4))
def test_all_runs_and_no_others(docs):
    ends = np.cumsum([len(d) for d in docs])
    s, e, q = find_runs(np.array(sum(docs, [])), ends)
    got = sorted(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True))
    assert got == sorted((a + o, n, p) for d, o in zip(docs, ends - [len(d) for d in docs], strict=True) for a, n, p in plain_runs(d))


def test_grammar_derives_the_words_at_each_position():
    ids = np.array(([1, 2, 3, 1, 2] * 9 + [4]) * 5 + [7] * 40)
    g = Grammar(ids, stretches(ids, np.array([len(ids)])))
    first, size = np.concatenate(g.first), np.concatenate(g.size)
    for k, at in zip(np.concatenate(g.whose), np.concatenate(g.places), strict=True):
        assert (ids[at : at + size[k]] == ids[first[k] : first[k] + size[k]]).all()
    assert g.made < len(ids) / 4  # it compresses


def test_prose_has_no_stretches():
    rng = np.random.default_rng(3)
    assert not stretches(rng.integers(0, 500, 20_000), np.array([20_000]))


def test_rows_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "b c " * 4 + "b y", "ab " * 30_000, "a b " * 8 + "É é", "w " * 7, "w " * 7]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "s", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start string, runs int, n_runs int")
    got = sorted((tuple(r)[1:8] for r in periodic_runs(docs).collect()), key=repr)
    assert got == sorted((plain_row((t or "").encode().split()) for t in texts), key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_text_longer_than_a_slice(spark):
    words = [f"w{i * i % 1_000_003}" for i in range(700_000)] + ["p", "q", "r"] * 8  # over 4 MB
    r = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 700_000, 24, 3, 8000)


def test_query_against_plain_reading(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text or "") < 30_000]
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert got[d.doc_id] == plain_row(planted_period(d.doc_id, (d.text or "").encode().split())), d.doc_id
