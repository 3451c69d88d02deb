import math
import random
from collections import Counter, defaultdict

import numpy as np

from annals.llm.language_id import ALPHABET, DISCOUNT, Models, fit, fit_language, identify, keep_identified, letters, predictions

WORDS = {"en": "the of and to hand thing water".split(), "de": "der und ist nicht schön wasser straße".split(), "it": "che di una acqua bello gli però".split()}


def brute(words, order, word):
    """Interpolated Kneser-Ney, written as its definition."""
    start = "\x02" * (order - 1)
    top = Counter()
    for w, n in words.items():
        s = start + w + "\x03"
        for i in range(order - 1, len(s)):
            top[s[i - order + 1 : i + 1]] += n
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(k, gram):
        if k == 0:
            return 1 / ALPHABET
        h = gram[:-1]
        total = sum(n for g, n in counts[k].items() if g[:-1] == h)
        if not total:
            return p(k - 1, gram[1:])
        kinds = sum(1 for g in counts[k] if g[:-1] == h)
        return max(counts[k][gram] - DISCOUNT, 0) / total + DISCOUNT * kinds / total * p(k - 1, gram[1:])

    s = start + word + "\x03"
    return -sum(math.log(p(order, s[i - order + 1 : i + 1])) for i in range(order - 1, len(s)))


def test_scores_are_kneser_ney():
    fits = [fit_language({w: k + 1 for k, w in enumerate(WORDS[x])}, 4) for x in ("en", "de")]
    m = Models.join(["en", "de"], fits, 4)
    new = ["thand", "schand", "ß", "zzz", "wasser", "漢"]
    got = m.score_words(new)
    for i, w in enumerate(new):
        for j, x in enumerate(("en", "de")):
            assert abs(got[i, j] - brute({w: k + 1 for k, w in enumerate(WORDS[x])}, 4, w)) < 1e-3 * abs(got[i, j])


def make(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS[x]) for _ in range(40)), x) for i in range(300) for x in [("en", "de", "it")[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 ²³ !!", "en"), (1003, "the hand", None), (1004, "xqzjk wvxqz " * 200, None), (None, "nicht schön", None), (1005, "the of water " * 30000, "en"), (0, rows[0][1], "en")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(3), rows


def test_tables(spark):
    docs, rows = make(spark)
    got = {r.doc_id: r for r in predictions(docs).collect()}
    assert len(got) == len(rows) - 1 and predictions(docs).count() == len(rows)
    for i, text, lang in rows:
        r = got[i]
        assert 0 <= r.score <= 1
        if not letters(text):
            assert (r.lang_pred, r.rejected) == ("und", True)
        elif lang:
            assert r.lang_pred == lang and not r.rejected
    assert (got[None].lang_pred, got[1003].lang_pred, got[1004].rejected) == ("de", "en", True)
    kept = keep_identified(docs, fit(docs))
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 4


def test_held_out_accuracy_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(none, fit(none)).collect()] == [("und", 0.0)]
    assert predictions(none.limit(0)).count() == 0
    assert defaultdict(int, Counter(letters("Ab1c_d é"))) == {"ab": 1, "c": 1, "d": 1, "é": 1}
