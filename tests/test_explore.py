"""Best-first exploration against a plain one, and each reason to stop."""

import random

import pytest

from annals.operators.explore import Budget, best_first


def plain(edges, nodes, seeds, targets, budget, per_round):
    out, links, kinds = [], {}, dict(nodes)
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    pool = {s: 0 for s in seeds if s in kinds}
    done, sources, have = set(), {}, [0] * len(targets)
    while True:
        front = sorted((n for n in pool if n not in done), key=lambda n: (-kinds[n][0], n))[:per_round]
        if not front:
            return out, "exhausted"
        fresh = {}
        for n in front:
            if all(h >= t for h, t in zip(have, targets.values(), strict=True)):
                return out, "target_reached"
            if len(out) >= budget.documents:
                return out, "budget_documents"
            done.add(n)
            score, source, *counts = kinds[n]
            if sources.get(source, 0) >= budget.per_source:
                continue
            sources[source] = sources.get(source, 0) + 1
            have = [h + c for h, c in zip(have, counts, strict=True)]
            out.append((n, pool[n]))
            if pool[n] < budget.depth:
                fresh.setdefault(pool[n], set()).update(links.get(n, ()))
        for d in sorted(fresh):
            new = sorted((m for m in fresh[d] if m not in pool and m in kinds and kinds[m][0] >= budget.min_score), key=lambda m: (-kinds[m][0], m))
            for m in new[: max(0, budget.linked - len(pool))]:
                pool[m] = d + 1


CASES = {
    "target_reached": ({"timeline": 6, "mapped": 4}, Budget(min_score=20)),
    "budget_documents": ({"timeline": 10**6}, Budget(documents=12, min_score=10, per_source=5)),
    "exhausted": ({"timeline": 10**6}, Budget(min_score=40, linked=25)),
}


@pytest.mark.parametrize("reason", CASES)
def test_visits_and_reasons(spark, reason):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(80)]
    edges = [(rng.choice(names), rng.choice([*names, "unknown"])) for _ in range(300)]
    nodes = [(n, (rng.randrange(100), rng.choice("abc"), rng.randrange(2), rng.randrange(2))) for n in names]
    targets, budget = CASES[reason]
    if len(targets) == 1:
        nodes = [(n, v[:3]) for n, v in nodes]
    e = spark.createDataFrame(edges, "src string, dst string")
    n = spark.createDataFrame([(k, *v) for k, v in nodes], "node string, score int, source string" + "".join(f", {t} int" for t in targets))
    s = spark.createDataFrame([("n1",), ("n2",), ("nowhere",)], "node string")
    got = best_first(e, n, s, targets, budget, per_round=7).orderBy("visit").collect()
    want, why = plain(edges, nodes, ["n1", "n2", "nowhere"], targets, budget, 7)
    assert why == reason and {r.reason for r in got} == {reason}
    assert [(r.node, r.depth) for r in got] == want and len(want) > 3


def test_query_stops_for_each_reason(spark):
    from annals import plans

    rows = plans.QUERIES["exploration_budgeted"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.run, r.reason) for r in rows} == {("targets", "target_reached"), ("documents", "budget_documents"), ("nodes", "exhausted")}
    assert max(r.depth for r in rows) > 1


def test_rounds_read_the_links_alone(spark):
    """What is known of the nodes is laid beside the links once: their rows are worked out once, however many rounds and explorations follow."""
    from pyspark.sql import functions as F

    from annals.operators.explore import laid_out

    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def score(n):
        made.add(1)
        return 50

    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    n = spark.createDataFrame([(f"n{i}",) for i in range(10)], "node string").select("node", score("node").alias("score"), F.lit("a").alias("source"), F.lit(0).alias("timeline"))
    table = laid_out(e, n)
    first = made.value
    got = best_first(e, n, spark.createDataFrame([("n0",)], "node string"), {"timeline": 1}, Budget(depth=9), links=table)
    assert got.count() == 10 and made.value <= first + 10  # the seeds look once more
