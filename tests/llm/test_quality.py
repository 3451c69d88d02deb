import numpy as np

from annals.llm.quality import DIM, RANK, STATS, Machine, features, quality_scores


def test_linear_time_form_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    m = Machine(0.3, rng.normal(size=DIM), rng.normal(size=(DIM, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    for text in ("a few words, a few", "", None):
        p, v = features(text, None)
        x = m.scale(p, v)
        pairs = sum(m.v[p[i]] @ m.v[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        want = 1 / (1 + np.exp(-np.clip(m.w0 + m.w[p] @ x + pairs, -30, 30)))
        assert abs(m.scores([(p, v)])[0] - want) < 1e-9


def test_training_is_plain_adagrad():
    """Machine.fit against a loop over documents, features and pairs."""
    rng = np.random.default_rng(4)
    docs = [features(" ".join(rng.choice(["good", "bad", "page", "click", "sea", "x"], 12)), None) for _ in range(40)]
    y = rng.integers(0, 2, 40).astype(float)
    got = Machine.blank().fit(docs, y, epochs=2)
    m = Machine.blank()
    stats = np.array([v[-len(STATS) :] for _, v in docs])
    m.mean, m.std = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    scaled = [(p, m.scale(p, v)) for p, v in docs]
    order_of, gw, gv, g0 = np.random.default_rng(11), np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6), 1e-6
    for _ in range(2):
        order = order_of.permutation(40)
        for i in range(0, 40, 32):
            of, dw, dv, d0 = order[i : i + 32], {}, {}, 0.0
            for j in of:
                p, x = scaled[j]
                pairs = sum(m.v[p[a]] @ m.v[p[b]] * x[a] * x[b] for a in range(len(p)) for b in range(a))
                err = (1 / (1 + np.exp(-(m.w0 + m.w[p] @ x + pairs))) - y[j]) / len(of)
                d0 += err
                for a in range(len(p)):
                    dw[p[a]] = dw.get(p[a], 0) + err * x[a]
                    dv[p[a]] = dv.get(p[a], 0) + err * x[a] * sum(m.v[p[b]] * x[b] for b in range(len(p)) if b != a)
            w, v = m.w.copy(), m.v.copy()
            for f in dw:
                g, gs = dw[f] + 1e-5 * w[f], dv[f] + 1e-5 * v[f]
                gw[f] += g**2
                gv[f] += gs**2
                m.w[f] -= 0.1 * g / np.sqrt(gw[f])
                m.v[f] -= 0.05 * gs / np.sqrt(gv[f])
            g0 += d0**2
            m.w0 -= 0.1 * d0 / np.sqrt(g0)
    assert np.allclose(got.w, m.w, atol=1e-6) and np.allclose(got.v, m.v, atol=1e-6) and abs(got.w0 - m.w0) < 1e-6


def test_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    # labels of held-out rows have no influence
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality_scores(docs, turned).collect()} == {(r.doc_id, r.score) for r in got.collect()}


def test_edges(spark):
    rows = [(1, "fine words here", 15), (2, None, None), (3, "", 0), (None, "no id", -4), (1, "fine words here", 15), (4, "bad !!! " * 20000, None)]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "doc_id long, text string, n_chars long, score double, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        got = quality_scores(docs, lab).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_scores(docs.limit(0), labels).count() == 0
