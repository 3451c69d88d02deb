"""Exploration of links between pages, hop by hop, with a set of pages already seen."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.session import written


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes that a seed reaches in at most ``depth`` hops, with the least number of hops.

    edges: src, dst; seeds: node. A hop joins the frontier alone with the edges and drops what was seen before; each
    frontier is written down, so no hop computes earlier ones again.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("node")
    for hop in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(hop)))
    return seen


@dataclass(frozen=True)
class Budget:
    """Limits of an exploration; the defaults are the usual ones."""

    documents: int = 10_000
    linked: int = 5_000
    depth: int = 3
    per_source: int = 2_500
    min_score: int = 35


def laid_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst) with the columns of the node dst, as a table sorted by src: what ``best_first`` reads, once for several explorations."""
    return written(edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "dst"), "dst").repartitionByRange("src").sortWithinPartitions("src"), "links")


VISIT = "node string, depth int, score int, visit int, reason string"


def best_first(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, targets: dict[str, int], budget: Budget = Budget(), per_round: int = 50, links: DataFrame | None = None) -> DataFrame:
    """(node, depth, score, visit, reason): pages in the order of their visit, the best known first.

    edges: src, dst. nodes: node, score, source and a count for each of ``targets``. seeds: node. A
    round visits the ``per_round`` best nodes of the frontier (score, then name); then what they link
    to joins the frontier, if it scores enough and was never seen, the best first, up to ``linked``
    nodes in all. It stops as soon as all targets are reached (target_reached), at ``documents`` visits
    (budget_documents), or when nothing is left (exhausted). Sources beyond their share are passed over.

    The driver holds a round and the visits, both bounded by parameters. Links lie in a table sorted by
    src with what is known of dst (``links``: a table of ``laid_out``, else one is made), so a round reads
    the row groups of its nodes and nothing else; the frontier is a table of what each round added.
    """
    spark = edges.sparkSession
    links = laid_out(edges, nodes) if links is None else links
    known = nodes.select("node", "score", "source", *targets)
    best = [F.desc("score"), F.asc("node")]
    pool = written(seeds.select("node").distinct().join(known, "node").withColumn("depth", F.lit(0)), "frontier")
    seen, done, visits = pool.count(), [], []
    have, by_source, reason = Counter(), Counter(), ""
    while not reason:
        gone = spark.createDataFrame([(n,) for n in done], "node string")
        front = pool.join(gone, "node", "left_anti").orderBy(*best).limit(per_round).collect()
        reason = "" if front else "exhausted"
        taken: dict[int, list[str]] = defaultdict(list)
        for r in front:
            if all(have[t] >= n for t, n in targets.items()):
                reason = "target_reached"
            elif len(visits) >= budget.documents:
                reason = "budget_documents"
            if reason:
                break
            done.append(r["node"])
            if by_source[r["source"]] >= budget.per_source:
                continue
            by_source[r["source"]] += 1
            have.update({t: r[t] for t in targets})
            visits.append((r["node"], r["depth"], r["score"], len(visits)))
            taken[r["depth"]].append(r["node"])
        for depth, names in sorted(taken.items()):
            if depth >= budget.depth or seen >= budget.linked:
                continue
            # a test for each name: of a long list only its least and greatest name are compared with a row group's
            asked = reduce(lambda a, b: a | b, [F.col("src") == n for n in names])
            found = links.filter(asked & (F.col("score") >= budget.min_score)).select(F.col("dst").alias("node"), "score", "source", *targets).distinct()
            fresh = found.join(pool.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth + 1))
            fresh = written(fresh.orderBy(*best).limit(budget.linked - seen), "frontier")
            pool, seen = pool.unionByName(fresh), seen + fresh.count()
    return spark.createDataFrame([(*v, reason) for v in visits], VISIT)
