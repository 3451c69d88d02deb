import math
import random
from collections import Counter

import numpy as np
import pytest

from annals.llm import lm_score
from annals.llm.common import alnum_words
from annals.llm.lm_score import ALPHA, lm_scores


def brute(rows, order):
    docs = [alnum_words(t) for _, t in rows]
    grams = [[Counter(tuple(d[i : i + k]) for i in range(len(d) - k + 1)) for k in range(1, order + 1)] for d in docs]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    out = []
    for (i, _), d, own in zip(rows, docs, grams, strict=True):
        seen = lambda g, own=own: total[len(g) - 1][g] - own[len(g) - 1][g]
        others, score, single = max(1, sum(map(len, docs)) - len(d)), 0.0, 0
        for p in range(len(d)):
            m = min(order, p + 1)
            for k in range(m, 1, -1):
                g = tuple(d[p - k + 1 : p + 1])
                if seen(g):
                    score += math.log(ALPHA ** (m - k) * seen(g) / seen(g[:-1]))
                    break
            else:
                score += math.log(ALPHA ** (m - 1) * (seen((d[p],)) or ALPHA) / others)
                single += 1
        out.append((i, len(d), single, round(score, 6)))
    return out


@pytest.mark.parametrize(("order", "bucket_bytes", "block_bytes"), [(3, 300, 500), (1, 8 << 20, 8 << 20), (4, 50, 1000)])
def test_matches_brute_force(spark, monkeypatch, order, bucket_bytes, block_bytes):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice(["the", "Sea", "of", "ü", "new%d" % rnd.randrange(40)]) for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (5, rows[5][1]), (None, "the sea of"), (103, "lonely")]
    if order == 3:
        rows.append((104, "the sea " * 20000))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, n_words int").repartition(3)
    got = lm_scores(docs, order, bucket_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_single, round(r.log_score, 3)) for r in got), key=repr) == sorted(((*w[:3], round(w[3], 3)) for w in brute(rows, order)), key=repr)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "one alone one")], "doc_id long, text string")
    assert [(r.n_words, r.n_single) for r in lm_scores(docs).collect()] == [(3, 3)]
    assert lm_scores(docs.limit(0)).count() == 0


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_moves_few_bytes_a_word(spark, monkeypatch):
    """All n-grams as rows took some 30 bytes a word there and as much back."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 300_000)
    rnd = random.Random(1)
    words = ["w%x" % rnd.randrange(1 << 30) for _ in range(20000)]
    docs = spark.createDataFrame([(i, " ".join(words[int(20000 * rnd.random() ** 4)] for _ in range(500))) for i in range(600)], "doc_id long, text string").repartition(2)
    before = shuffled_bytes(spark)
    assert lm_scores(docs, 3, 300_000).count() == 600
    moved = sum(b for s, b in shuffled_bytes(spark).items() if s not in before)
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert moved - text < 16 * 600 * 500, (moved, text)


def test_numbers_and_pairs_are_exact():
    for values in ([], [0], [255, 256], [2**63, 1, 2**64 - 1], list(range(70000))):
        assert lm_score.unpack(lm_score.pack(np.array(values, np.uint64))).tolist() == values
    block = object.__new__(lm_score.Block)
    block.n_parts, block.tops = 7, [1000, 3000]
    head, word = np.repeat(np.arange(3000), 1000), np.tile(np.arange(1000), 3000)
    mixed, width = block.mix(3, head, word)
    assert len(np.unique(mixed)) == 3_000_000
    sizes = np.bincount((mixed // np.uint64(width)).astype(np.int64))
    assert len(sizes) == 7 and sizes.max() < 1.1 * sizes.min()
    block.tops = [1 << 32, 1 << 32]
    with pytest.raises(OverflowError):
        block.mix(3, head[:1], word[:1])
