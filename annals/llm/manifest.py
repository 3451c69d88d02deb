"""Merkle manifest of a table: a content-addressed graph of digests, and inclusion proofs by descent.

A leaf is the digest of one row. Leaves are ranked within their source without gathering a source in
one task: rows are dealt by ranges of (source, doc_id), counted by range, and numbered from the sums.
Every FANOUT consecutive nodes become one, level by level; each level is a table of records digest ->
children, a group of at most FANOUT rows. The subroots of the sources form the leaves of a last tree.

Proofs descend from the root. A request is a prefix of rank digits (base FANOUT) that the wanted
leaves share, so a node is asked once for all leaves below it: the request finds its digest's record
by an equal join, follows each digit, and keeps the children that it doesn't follow as a segment of
its path. At the leaf the segments are reversed, so that they lead from leaf to root.

Work: the texts are read once and don't move; what moves are digests, n + n/16 + n/256 + ... of them,
and paths of n/16 nodes. The number of jobs grows with the logarithm of the rows. Nothing that grows
with the rows is broadcast; the driver gets a sample for the bounds of the ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

FANOUT = 16
#: Rows of a range that are ranked together. Spark sends some 300 rows a range to the driver to choose the bounds.
RANGE_ROWS = 32_768
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOAD = "struct<doc_id:{id},tampered:string,height:int>"
NO_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """One row per row of docs: grp (the source, so that null comes first), doc_id, digest, tampered.

    ``tamper`` marks rows whose text is lower-cased (A-Z) in ``tampered``; there it is the digest of
    that row, elsewhere null.
    """
    fields = [F.col(f"_d_{c}") for c in FIELDS]
    rows = docs.select(*[F.col(c).alias(f"_d_{c}") for c in FIELDS])
    other = digest(*map(encoded, [*fields[:-1], ascii_lower(fields[-1])]))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("_d_source").cast("string")), F.lit("")).alias("grp"),
        F.col("_d_doc_id").alias("doc_id"),
        digest(*map(encoded, fields)).alias("digest"),
        (F.lit(None).cast("string") if tamper is None else F.when(tamper, other)).alias("tampered"),
    )


def every_fifth(doc_id: Column) -> Column:
    """Where 5 divides the crc32 of the decimal id; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows with idx, the place among the rows of their grp by ``order``, and n, the rows of the grp."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = cut(rows.repartitionByRange(ranges, "grp", *order).withColumn("part", F.spark_partition_id()), label)
    by_part = dealt.groupBy("part", "grp").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select("part", "grp", before.alias("before"), F.sum("m").over(whole).alias("n"))
    here = F.row_number().over(Window.partitionBy("part", "grp").orderBy(*order))
    return dealt.withColumn("here", here).join(offsets, ["part", "grp"]).withColumn("idx", F.col("before") + F.col("here") - 1).drop("part", "here", "before")


def build(rows: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of a tree for each grp, from rows with grp, idx, n, digest and load.

    Returns the records of each level above the leaves (digest, kids) and the tops (grp, digest,
    height, load); the load of a top is null unless its grp has one leaf.
    """
    rows = cut(rows.select("grp", "idx", "n", "digest", "load"), f"{label}-0")
    most = rows.agg(F.max("n")).first()[0] or 0
    records, at, height = [], rows, 0
    tops = [rows.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"), "load")]
    while most > 1:
        most, height = -(-most // FANOUT), height + 1
        run = F.floor(F.col("idx") / FANOUT).cast("long")
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", "load")))
        up = at.filter("n > 1").groupBy("grp", run.alias("up"), F.ceil(F.col("n") / FANOUT).cast("long").alias("m")).agg(kids.alias("kids"))
        up = up.select("grp", F.col("up").alias("idx"), F.col("m").alias("n"), digest(F.array_join(F.col("kids.digest"), "")).alias("digest"), "kids")
        level = cut(up, f"{label}-{height}")
        records.append(level.select("digest", "kids"))
        at = level.select("grp", "idx", "n", "digest", F.lit(None).cast(rows.schema["load"].dataType).alias("load"))
        tops.append(at.filter("n = 1").select("grp", "digest", F.lit(height).alias("height"), "load"))
    return records, reduce(DataFrame.unionByName, tops)


def descend(requests: DataFrame, records: list[DataFrame]) -> DataFrame:
    """The leaves below the requests, which have digest, height, path, load and columns of their own.

    A path gets one segment a level, the digests left and right of the child that is followed.
    """
    found = [requests.filter("height = 0")]
    moving = None
    own = [c for c in requests.columns if c not in ("digest", "height", "path", "load")]
    for height in range(len(records), 0, -1):
        here = requests.filter(F.col("height") == height)
        here = here if moving is None else here.unionByName(moving)
        record = records[height - 1].dropDuplicates(["digest"])  # equal nodes are stored once
        # Spark doesn't count on a path growing and a node having FANOUT children, so it would take requests of any size for small and broadcast them
        step = here.drop("load").hint("merge").join(record, "digest").withColumn("names", F.col("kids.digest"))
        step = step.select(*own, "path", "names", F.posexplode("kids").alias("digit", "kid"))
        segment = F.struct(
            F.array_join(F.slice("names", F.lit(1), F.col("digit")), "").alias("left"),
            F.array_join(F.slice("names", F.col("digit") + 2, F.lit(FANOUT)), "").alias("right"),
        )
        moving = step.select(
            *own, F.lit(height - 1).alias("height"), F.col("kid.digest").alias("digest"), F.col("kid.load").alias("load"),
            F.concat("path", F.array(segment)).alias("path"),
        )
    return reduce(DataFrame.unionByName, found if moving is None else [*found, moving])


def manifest_proofs(docs: DataFrame, tamper=every_fifth) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tamper`` (a function of the doc_id column, or None) says which rows are checked as if A-Z of
    their text were lower-cased. folded_root is made from that leaf and the siblings of the stored one.

    Null sources are a source, ordered first; null doc_ids come first in theirs and aren't tampered
    with; a null text stays null, which differs from an empty one. Rows that repeat a doc_id are
    ordered by leaf; equal rows are leaves of their own with equal digests. A tree of one leaf is that
    leaf, its proof the digest of nothing. An empty table gives no rows. Columns beside the five
    fields are not looked at.
    """
    spark = docs.sparkSession
    rows = cut(leaves(docs, tamper(F.col("_d_doc_id")) if tamper else None), "leaves")
    load = LOAD.format(id=rows.schema["doc_id"].dataType.simpleString())
    payload = F.struct("doc_id", "tampered", F.lit(0).alias("height")).cast(load).alias("load")
    records, tops = build(ranked(rows, ["doc_id", "digest"], "ranked").select("grp", "idx", "n", "digest", payload), "tree")

    # the subroots are leaves of one more tree; what a subroot has to hand on is its height, and its row if it is a leaf
    handed = F.struct(F.col("load.doc_id").alias("doc_id"), F.col("load.tampered").alias("tampered"), "height").cast(load).alias("load")
    sources = tops.select(F.col("grp").alias("source"), "digest", handed, F.lit("").alias("grp"))
    top_records, top = build(ranked(sources, ["source"], "sources"), "top")
    roots = top.select("digest", "height", "load", F.col("digest").alias("root"), F.expr(f"cast(array() as {NO_PATH})").alias("path"))
    subroots = descend(roots, top_records).select("root", F.col("digest").alias("subroot"), "digest", F.col("load.height").alias("height"), "path", "load")
    at_leaf = descend(cut(subroots, "subroots"), records)
    return proofs(spark, at_leaf)


def proofs(spark: SparkSession, at_leaf: DataFrame) -> DataFrame:
    """What a proof shows: the digest of its siblings and the root that it leads to."""
    seg = at_leaf.select("root", "subroot", F.col("digest").alias("leaf"), "load", F.reverse("path").alias("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("load.tampered", "leaf"), lambda at, s: digest(s["left"], at, s["right"]))
    out = seg.select(F.col("load.doc_id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
