"""Tables of versions, metrics of a run, claims with their best evidence."""

import random

import pytest

from annals.operators import metrics, reads
from annals.operators.versions import VersionedTable, merged

BASE = "id int, kind string, status string, note string"


def plain(base, changes):
    """Changes one after the other: published rows stay, a known kind stays, nulls change nothing."""
    rows = {r[0]: list(r) for r in base}
    for version, key, kind, status, note in sorted(changes):
        row = rows.setdefault(key, [key, None, None, None])
        if row[2] == "published":
            continue
        if kind is not None and row[1] in (None, "unknown"):
            row[1] = kind
        row[2] = status if status is not None else row[2]
        row[3] = note if note is not None else row[3]
    return sorted(map(tuple, rows.values()), key=repr)


def generated(seed):
    rng = random.Random(seed)
    kinds, states = [None, "unknown", "person", "place"], [None, "draft", "ready", "published"]
    base = [(i, rng.choice(kinds), rng.choice(states), rng.choice([None, "n0"])) for i in range(30)]
    changes = [(v, k, rng.choice(kinds), rng.choice(states), rng.choice([None, f"n{v}"])) for v in range(1, 7) for k in rng.sample(range(40), 15)]
    return base, changes


RULES = {"frozen": ("status", "published"), "first_known": {"kind": "unknown"}}


def collected(df):
    return sorted((tuple(r[c] for c in ("id", "kind", "status", "note")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_in_one_merge(spark, seed):
    base, changes = generated(seed)
    c = spark.createDataFrame(changes, "version int, id int, kind string, status string, note string")
    assert collected(merged(spark.createDataFrame(base, BASE), c, "id", **RULES)) == plain(base, changes)


def test_reads_before_and_after_compaction_agree(spark, tmp_path):
    base, changes = generated(7)
    table = VersionedTable(spark, str(tmp_path / "t"), "id", **RULES)
    table.create(spark.createDataFrame(base, BASE))
    assert collected(table.read()) == plain(base, [])
    for v in range(1, 7):
        rows = [c[1:] for c in changes if c[0] == v]
        table.change(spark.createDataFrame(rows, "id int, kind string, status string, note string"), v)
        if v == 2:
            table.change(spark.createDataFrame(rows, "id int, kind string, status string, note string"), v)  # run again
        want = plain(base, [c for c in changes if c[0] <= v])
        assert collected(table.read()) == want
        if v in (3, 6):
            table.compact()
            assert collected(table.read()) == want and table._versions("base")[-1] == v
    with pytest.raises(ValueError):
        table.change(spark.createDataFrame([(1, "x", None, None)], BASE), 6)


def test_metrics_of_the_pass_equal_a_second_count(spark, tmp_path):
    rows = [("created", None)] * 3 + [("reinforced", None)] * 2 + [("needs_review", "competing_place")] * 4 + [("rejected", "singleton_cardinality_violation")]
    df = spark.createDataFrame(rows, "outcome string, code string")
    watched, seen = metrics.observed(df, "run")
    watched.write.parquet(str(tmp_path / "out"))
    r = metrics.loss_reasons(df).first().asDict()
    assert r["losses"] == {"competing_place": 4, "singleton_cardinality_violation": 1} and r["accepted"] == 5 and r["candidates"] == 10
    assert seen.get == {k: r[k] for k in ("candidates", *metrics.OUTCOMES)} | r["losses"]
    assert metrics.loss_reasons(df.limit(0)).first().candidates == 0


def test_best_evidence(spark):
    f = spark.createDataFrame
    events = f([(1, "anecdote", "t1", 60), (2, "birth", "t2", 60), (3, "birth", "t3", 60), (4, "birth", "t4", 60)], "event_id int, event_type string, text string, confidence int")
    evidence = f([(1, 10, "a", 1, None), (1, 11, None, 1, 5), (1, 12, "c", 2, 5), (2, 13, "d", None, None), (3, 14, "e", 9, 1)], "event_id int, evidence_id int, quoted_text string, sentence_id int, confidence int")
    sentences = f([(1, 7, "said"), (2, 8, "other")], "sentence_id int, page_id int, sentence string")
    pages = f([(7, "en", "A B", 99)], "page_id int, lang string, title string, revision int")
    got = {r.event_id: (r.kind, r.quote, r.locator) for r in reads.backfill_claims(events, f([(3,)], "event_id int"), evidence, sentences, pages).collect()}
    assert got == {1: ("anecdote", "said", "https://en.wikipedia.org/w/index.php?title=A_B&oldid=99"), 2: ("life_event", "d", None), 4: ("life_event", None, None)}


def test_mentions_are_told_apart(spark):
    f = spark.createDataFrame
    entities = f([("josephine", "Joséphine", "person"), ("Paris", "Paris", "place"), ("Code", "Civil Code", "work")], "surface string, label string, kind string")
    rows = f(
        [(1, " PARIS ", "Code", [("Ann", "witness"), ("Josephine", "spouse")]), (2, "Josephine", "josephine", None), (3, "Nowhere", " ", []), (4, "code", "thing", None), (5, None, None, None)],
        "id int, place string, thing string, others array<struct<surface: string, role: string>>",
    )
    got = {r.id: r for r in reads.resolve_mentions(rows, entities, "place", "thing", "others", "id").collect()}
    said = lambda ms: [tuple(m) for m in ms]
    assert said(got[1].place_mentions) == [("Paris", "place", None)] and said(got[1].object_mentions) == [("Civil Code", "work", None)]
    assert said(got[1].participant_mentions) == [("Ann", "unknown", "witness"), ("Joséphine", "person", "spouse")]
    assert got[2].invalid_place and got[2].place_label is None and said(got[2].participant_mentions) == [("Joséphine", "person", "spouse")] * 2
    assert said(got[3].place_mentions) == [("Nowhere", "unknown", None)] and not got[3].object_mentions and not got[3].invalid_place
    assert said(got[4].object_mentions) == [("Civil Code", "work", None), ("thing", "unknown", None)] and got[4].mention_role == "object"
    assert not got[5].place_mentions and not got[5].invalid_place and set(got[5].asDict()) == {"id", "place", "thing", "others", "place_label", "place_kind", "mention_role", "invalid_place", "place_mentions", "object_mentions", "participant_mentions"}
