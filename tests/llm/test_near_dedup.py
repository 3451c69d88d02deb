import random

import pytest
from pyspark.sql import functions as F

from annals.llm.common import space_words
from annals.llm.near_dedup import SIGNED, components, hub_blocks, keep_one, least_collisions, near_duplicates, prefixes, signer, with_digest


def brute(rows, size=5, percent=85):
    """{row: (n_shingles, component)} from all pairs."""
    sets = []
    for _, t in rows:
        w = space_words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)]


def make(seed, n=40, copies=6):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], 0
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 40, 120, 300]))]
        if i % 3 == 0:
            words += passage.split()
        for _ in range(rnd.randrange(1, copies)):
            own = list(words)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rows.append((base * 7 % 100_003, " ".join(own)))
            base += 1
    star = [rnd.choice(vocab) for _ in range(200)]  # a large group of near copies
    for _ in range(60):
        own = list(star)
        for _ in range(rnd.randrange(1, 4)):
            own[rnd.randrange(200)] = rnd.choice(vocab)
        rows.append((base * 7 % 100_003, " ".join(own).upper()))
        base += 1
    rows += [(500_000, None), (500_001, ""), (500_002, " \t"), (500_003, "one two"), (500_004, "One\ntwo"), (500_005, "two one"), (None, rows[0][1]), (None, "nobody else has this"), (500_006, "many words " * 20000), (500_006, "many words " * 20000)]
    return rows


@pytest.mark.parametrize(("seed", "block_hashes"), [(1, 1 << 20), (2, 3000)])
def test_matches_brute_force(spark, seed, block_hashes):
    rows = make(seed)
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, cls string, label int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, block_hashes=block_hashes).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    if seed == 1:
        kept = keep_one(docs, percent=85)
        assert kept.columns == docs.columns
        kept = [r.doc_id for r in kept.collect()]
        assert sorted(map(str, kept)) == sorted({str(d) for d, _, c in brute(rows) if d == c})


def test_keeps_one_of_rows_that_repeat_an_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(7, base), (7, base + " more"), (7, base), (8, base + " end"), (None, base + " x"), (9, None), (9, ""), (9, None), (None, "alone here"), (None, "alone here")]
    kept = keep_one(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, first int")).collect()
    assert [r.doc_id for r in kept if r.text and r.text.startswith("w0")] == [7]
    assert sorted(str(r.text) for r in kept if r.doc_id == 9) == ["", "None", "None"]
    assert [r.text for r in kept if r.doc_id is None] == ["alone here"]


def test_narrow_coordinates_do_not_chain(spark):
    """With 14 bits many lists hold strangers; only members of a hub's lists meet, in bounded blocks, and the result stays."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(5000)) for _ in range(120))) for i in range(600)]
    rows += [(600 + i, t + " tail") for i, (_, t) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(signer(5, 64, 14), SIGNED)
    classes = signed.withColumn("cls", F.col("doc_id")).select("cls", "n_shingles", "sig").cache()
    t = least_collisions(64, 85)
    posts = prefixes(classes, 64, t)
    sets = docs.select("text").mapInArrow(with_digest(5), "d1 long, d2 long, n_shingles long, hashes array<long>").join(signed.select("d1", "d2", F.col("doc_id").alias("cls")), ["d1", "d2"]).select("cls", "hashes", F.size("hashes").alias("n_shingles"))
    rows_of_lists = posts.withColumn("label", F.col("cls"))
    largest = hub_blocks(sets, rows_of_lists, 64, 1 << 19).groupBy("hub", "xb", "yb").count().agg(F.max("count")).first()[0]
    whole = hub_blocks(sets, rows_of_lists, 1 << 30, 1 << 40).filter("role = 1").groupBy("hub").count().agg(F.max("count")).first()[0]
    assert largest < 260 and whole < 620
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, bits=14, block_rows=64).collect())
    assert got == sorted(brute(rows))


def test_a_large_group_spreads_over_blocks(spark):
    """A third of all rows are near copies of one text, some only of other copies."""
    rnd = random.Random(11)
    star, rows = [f"s{i}" for i in range(150)], [(i, " ".join(f"o{rnd.randrange(9000)}" for _ in range(60))) for i in range(400)]
    for i in range(200):
        own = list(star)
        for _ in range(rnd.randrange(1, 6)):
            own[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((400 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, block_rows=32).collect())
    assert got == sorted(brute(rows))


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    links = [(a, b) for a, b in links if a != b]
    near: dict[int, set[int]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
