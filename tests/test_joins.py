"""Joins without products: aliases by an index of words, intervals by bins, totals by ranges."""

import random

from pyspark.sql import functions as F

from annals.operators import corpus

FOLD = str.maketrans("éÉ", "ee")


def test_aliases_are_found_wherever_they_occur(spark):
    rng = random.Random(4)
    bits = ["ro", "me", "rome", "Roméo", "sa", "saint", "helena", "Saint Helena", "x", "of", "ab", "a b c", "in", "elba", "dé"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(bits) + rng.choice(["", "s", ".", ","]) for _ in range(rng.randint(1, 6)))])
    docs = [(i, text(), text(), text(), text()) for i in range(150)]
    aliases = [("r", "Romé"), ("r", "meo"), ("h", "Saint Helena"), ("h", "helena"), ("s", "a b c"), ("t", "t H"), ("u", "of"), ("v", "nowhere"), ("w", "   "), ("x", "s. x"), ("y", "abs"), ("y", "abs"), ("z", "t h")]
    got = corpus.match_subjects(spark.createDataFrame(docs, "doc_id int, title string, abstract string, author string, keyword string"), spark.createDataFrame(aliases, "subject string, alias string"))
    want = set()
    for i, *fields in docs:
        low = [(f or "").translate(FOLD).lower() for f in fields]
        for s in {s for s, _ in aliases}:
            points = [0, 0, 0, 0]
            for a in {a for t, a in aliases if t == s and len(a.encode()) >= 3 and a.strip()}:
                hit = [a.translate(FOLD).lower() in f for f in low]
                points = [max(p, h * n) for p, h, n in zip(points, hit, (45, 25 if " " in a else 35, 35, 15), strict=True)]
            if sum(points) >= 30:
                names = [n for n, p in zip(("title", "abstract", "keyword", "author"), (points[0], points[1], points[3], points[2]), strict=True) if p]
                want.add((i, s, "by" if points[2] else "about", min(100, sum(points)), ",".join(names)))
    assert {tuple(r) for r in got.collect()} == want and len({w[1] for w in want}) > 5


def test_work_grows_with_words_and_hits(spark):
    """No array of all aliases, no product: a rare alias meets only the documents of its words."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("title"), *[F.lit("").alias(c) for c in ("abstract", "author", "keyword")])
    aliases = spark.range(300).select(F.concat(F.lit("s"), "id").alias("subject"), F.concat(F.lit("word"), F.col("id") + 390).alias("alias"))
    texts = docs.select("doc_id", F.array("title").alias("words"))
    known = aliases.select("subject", "alias", F.col("alias").alias("folded"))
    assert corpus.alias_hits(texts, known).count() == 10
    plan = corpus.match_subjects(docs, aliases)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "collect_list" not in plan


def test_overlaps_once_each(spark):
    rng = random.Random(2)
    span = lambda: (a := rng.randint(-60, 200), a + rng.choice([-3, 0, 1, 30, 300]))
    spans, periods = [(i, *span()) for i in range(60)] + [(60, None, 3), (61, 3, None)], [(f"p{i}", *span()) for i in range(40)] + [("n", None, None)]
    a, b = spark.createDataFrame(spans, "k int, start_year int, end_year int"), spark.createDataFrame(periods, "period string, first_year int, last_year int")
    want = sorted((k, p) for k, s, e in spans for p, f, z in periods if None not in (s, e, f, z) and e >= f and s <= z)
    for width in (1, 32, 1000):
        assert sorted((r.k, r.period) for r in corpus.overlapping(a, b, width).collect()) == want


def test_running_total(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "n int, size int").repartition(5)
    got = {r.n: r.total for r in corpus.running_total(rows, "n", "size", "total").collect()}
    assert got == {i: sum(k % 7 for k in range(i + 1)) for i in range(500)}
