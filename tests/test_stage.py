"""The event stage: by hand, as a stream in batches, and over the given tables."""

import random

import pytest
from oracle import compare

from annals import plans
from annals.operators import stage
from annals.streaming.stage import CANDIDATE, run_stage

SF = "/root/testdata/sf0.001"


def candidate(n, stem, place, kind="battle", person="Ann"):
    return (n, person, kind, stem, f"{stem}@{place}", place)


def decided(spark, rows):
    return stage.decide(spark.createDataFrame(rows, CANDIDATE))


def outcomes(df):
    return {r.event_id: (r.outcome, r.code, r.places, r.event) for r in df.collect()}


def test_first_place_stays_and_later_ones_go_to_review(spark):
    rows = [candidate(1, "s", "paris"), candidate(2, "s", "paris"), candidate(3, "s", ""), candidate(4, "s", "elba"), candidate(5, "s", "paris"), candidate(6, "t", "rome")]
    got = outcomes(decided(spark, rows))
    assert got[1] == ("created", None, None, 1) and got[2] == ("reinforced", None, None, 1) and got[3] == ("created", None, None, 3)
    assert got[4] == ("needs_review", "competing_place", ["elba", "paris"], None)
    assert got[5] == ("needs_review", "competing_place", ["elba", "paris"], None)  # the stem is disputed by now
    events = {r.event_id: (r.support, r.status) for r in stage.event_table(decided(spark, rows)).collect()}
    assert events == {1: (2, "uncertain"), 3: (1, "uncertain"), 6: (1, "attested")}


def test_events_after_the_dispute_are_attested(spark):
    rows = [candidate(1, "s", "paris"), candidate(2, "s", "elba"), candidate(3, "s", "")]
    assert {r.event_id: r.status for r in stage.event_table(decided(spark, rows)).collect()} == {1: "uncertain", 3: "attested"}


def test_births_are_singletons_by_person(spark):
    rows = [candidate(1, "b1", "ajaccio", "birth"), candidate(2, "b2", "corte", "birth"), candidate(3, "b1", "ajaccio", "birth"), candidate(4, "b1", "corte", "birth"), candidate(5, "b1", "x", "birth", "Bob")]
    got = outcomes(decided(spark, [*rows[:4], candidate(5, "c1", "x", "birth", "Bob")]))
    assert [got[k][0] for k in (1, 2, 3, 4, 5)] == ["created", "rejected", "reinforced", "needs_review", "created"]
    assert got[2][1] == "singleton_cardinality_violation"


def generated(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        person, kind, year = rng.choice("AB"), rng.choice(["birth", "death", "battle", "travel"]), rng.randint(1, 2)
        out.append(candidate(i, f"{person}{kind}{year}", rng.choice(["", "paris", "elba", "rome"]), kind, person))
    return out


def one_by_one(rows):
    """The rule, read literally: a candidate is compared with all before it."""
    places, events, out = {}, {}, {}
    for n, person, kind, stem, key, place in sorted(rows):
        rivals = {p for p in places.get(stem, ()) if place and p != place}
        if place:
            places.setdefault(stem, set()).add(place)
        of_kind = [k for k, (w, t, _) in events.items() if (w, t) == (person, kind)]
        if rivals:
            out[n] = ("needs_review", "competing_place", sorted(rivals | {place}), None)
        elif key in events:
            out[n] = ("reinforced", None, None, events[key][2])
        elif kind in ("birth", "death") and of_kind:
            out[n] = ("rejected", "singleton_cardinality_violation", None, None)
        else:
            events[key] = (person, kind, n)
            out[n] = ("created", None, None, n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_form_reads_like_one_by_one(spark, seed):
    rows = generated(120, seed)
    assert outcomes(decided(spark, rows)) == one_by_one(rows)


@pytest.mark.parametrize("cuts", [(0, 120), (0, 31, 78, 120)])
def test_stream_in_any_split_equals_one_batch(spark, tmp_path, cuts):
    rows = generated(120, 3)
    drop, table, point = (str(tmp_path / n) for n in ("in", "table", "cp"))
    frame = lambda part: spark.createDataFrame(part, CANDIDATE).coalesce(1)

    def step():
        run_stage(spark.readStream.schema(CANDIDATE).parquet(drop), table, point).awaitTermination()
        return outcomes(spark.read.parquet(table))

    for a, b in zip(cuts, cuts[1:], strict=False):
        frame(rows[a:b]).write.mode("append").parquet(drop)
        got = step()
    assert got == outcomes(decided(spark, rows)) == one_by_one(rows)
    assert spark.read.parquet(table).count() == 120
    frame(rows[20:60]).write.mode("append").parquet(drop)  # a batch comes again
    assert step() == got and spark.read.parquet(table).count() == 120


@pytest.mark.parametrize("name", ["event_stage", "event_table", "competing_abstention"])
def test_queries_see_conflicts(spark, name):
    compare(spark, SF, plans.QUERIES[name], plans.SQL[name])
    rows = plans.QUERIES[name](spark, SF)
    kinds = {r[0] for r in rows.select("outcome" if name == "event_stage" else "status").distinct().collect()}
    assert len(kinds) > 1 and kinds & {"needs_review", "uncertain"}


@pytest.mark.parametrize("name, module", [("status_updates", "read_queries"), ("density_counts", "store_queries")])
def test_candidates_are_judged_once(spark, monkeypatch, name, module):
    import importlib

    from annals.plans import events

    calls, real = [], events.judged
    monkeypatch.setattr(events, "judged", lambda *a: calls.append(1) or real(*a))
    getattr(importlib.import_module(f"annals.plans.{module}"), name)(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_work_on_events_is_dealt_out(spark):
    """A file of one split is no reason to judge it in one task."""
    from annals.plans.synth import dealt

    assert dealt(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
