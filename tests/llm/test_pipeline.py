"""Each stage of the pipeline against a brute-force reading of its own input, then the whole run."""

import random
from collections import defaultdict

import corpus_pipeline
from annals.llm.language_id import letters
from tests_llm_brute import contaminated, near_groups, token_ids

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to hand thing water stone river house light over".split(), "de": "der und ist nicht schön wasser straße haus licht fluss über stein".split()}


def make(spark, path):
    rnd = random.Random(8)
    say = lambda lang, n: " ".join(rnd.choice(WORDS[lang]) + str(rnd.randrange(9)) * (rnd.random() < 0.5) for _ in range(n))
    items = [(i, say("en", 14)) for i in range(3)]
    rows = [(i, say(lang, rnd.randrange(30, 90)), lang) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100 + i, rows[i][1].upper(), rows[i][2]) for i in range(6)]  # equal but for A-Z
    rows += [(200 + i, rows[i + 10][1] + " more", rows[i + 10][2]) for i in range(5)]  # near copies
    rows += [(300, f"{say('en', 20)} {items[1][1]} {say('en', 20)}", "en"), (301, None, "en"), (302, "", None), (303, "12 ²³ !!", "de"), (304, "the hand", None), (305, say("en", 6000), "en")]
    spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    now = {i: t for i, t, _ in rows}

    def step(name, docs, want):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        assert {r.doc_id: r.text for r in out.collect()} == want
        return out, want

    docs, now = step("language_id", docs, {i: t for i, t in now.items() if letters(t)})
    keep = defaultdict(int)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    for i, t in now.items():
        keep[lower(t)] = max(keep[lower(t)], i)
    docs, now = step("exact_dedup", docs, {i: t for i, t in now.items() if keep[lower(t)] == i})
    docs, now = step("near_dedup", docs, {i: t for i, t in now.items() if i in near_groups(now, 80)})
    docs, now = step("decontaminate", docs, {i: t for i, t in now.items() if not contaminated(t, items, 10)})
    assert 300 not in now and 305 in now
    pieces = stages["pack"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(token_ids(t)) + 1 for i, t in now.items()}
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_extra_columns(spark, tmp_path):
    rows, items = make(spark, tmp_path / "whole")
    some = [r for r in rows if r[0] < 60]
    some += [(None, rows[0][1] + " x", "en"), (None, rows[0][1] + " x", "en"), (7, rows[7][1], "de"), (8, None, None), (None, None, None), (9, rows[9][1] + " once more", "de")]
    docs = spark.createDataFrame([(i, t, x, "src", 1, "k", 2) for i, t, x in some], COLUMNS + ", cls string, `_n` int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-2:] == ["cls", "_n"]
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(kept) == list(range(60))  # null ids were near copies, repeated rows stay once
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(60))
