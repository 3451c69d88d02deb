import random

from annals.llm.language_id import fit, identify

WORDS = {"en": "the of and to hand thing water".split(), "de": "der und ist nicht wasser stein".split()}


def rows(rnd, n):
    return [(i, " ".join(rnd.choice(WORDS[x]) for _ in range(rnd.randrange(1, 60))), x) for i in range(n) for x in [("en", "de")[i % 2]]]


def rejected(spark, train, texts):
    models = fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.rejected for r in sorted(identify(docs, models).collect(), key=lambda r: r.doc_id)]


def test_short_foreign_scripts_and_junk_are_rejected(spark):
    rnd = random.Random(3)
    foreign = ["вода и камень", "水は石の上を流れる", "ξυλο και νερο στο βουνο " * 2]
    gibberish = ["".join(rnd.choice("qxzjkvw") for _ in range(6)) + " " + "".join(rnd.choice("qxzjkvw") for _ in range(50))]
    clean = ["the", "of water", "stein und wasser", "nicht der stein", "the hand and the water"]
    train = rows(rnd, 400)
    assert rejected(spark, train, foreign + gibberish + clean) == [True] * 4 + [False] * 5
    # junk and wrong labels among what calibrates
    bad = [(1000 + i, " ".join("".join(rnd.choice("qxzjkvw") for _ in range(7)) for _ in range(40)), "en") for i in range(16)]
    bad += [(2000 + i, " ".join(rnd.choice(WORDS["de"]) for _ in range(30)), "en") for i in range(8)]
    unlike = ["".join(rnd.choice("bcdfghlmnprst") for _ in range(9)) + " " + "".join(rnd.choice("bcdfghlmnprst") for _ in range(9)) for _ in range(6)]
    assert rejected(spark, train + bad, [" ".join(unlike), *foreign, *clean]) == [True] * 4 + [False] * 5
