"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition sorts its digests into a run with one entry per digest: the digest, a second
independent hash and the length that verify it, the best identifier and the number of rows. In
binomial rounds the runs are exchanged: in each round a node hands its entries to the nodes that
agree with it in all but the next ``radix_bits`` bits of its number, which come from the digest.
What a node gets is merged in sorted order (Spark's external sort, which spills) and entries of one
digest that follow each other become one, in one pass over the merged rows that holds a batch.
There are about as many nodes as input partitions; after log2(nodes) / radix_bits rounds every
digest lies on one node. A digest with a third of all rows has one entry per input partition at
first and at most 2**radix_bits entries in any later merge, so no task ever sees its rows together.

Results go back to the rows by an equal join, but for digests with at least one in HOT of all rows:
of these there are at most HOT, whatever the table, so they travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

ENTRY = ("digest", "check", "length")
HOT = 4096  # a digest with one in so many of all rows is joined by broadcast


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of the text: null counts as empty, only A-Z are lower-cased."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("_t")).select(
        "doc_id", F.sha2(F.encode("_t", "utf-8"), 256).alias("digest"), F.xxhash64("_t").alias("check"), F.length("_t").alias("length")
    )


RUN = "node long, digest string, check long, length int, keep_id {id}, group_size long"


def merger(keep: str):
    """Merge rows sorted by node, digest, check and length, whose columns are those of RUN: neighbours with equal keys become one entry."""
    keys = ("node", *ENTRY)

    def combine(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        new = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for c in keys:
                col = batch.column(c)
                same &= pc.equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        starts = np.flatnonzero(new)
        if len(starts) == n:
            return batch
        entries = batch.take(pa.array(starts))
        ids = pa.table({"g": np.cumsum(new) - 1, "id": batch.column("keep_id"), "n": batch.column("group_size")}).group_by("g").aggregate([("id", keep), ("n", "sum")]).sort_by("g")
        columns = {c: entries.column(c) for c in entries.schema.names}
        columns["keep_id"], columns["group_size"] = (ids.column(c).combine_chunks() for c in (f"id_{keep}", "n_sum"))
        return pa.RecordBatch.from_pydict(columns, schema=batch.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last entry, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            merged = combine(batch)
            held = merged.slice(merged.num_rows - 1)
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
        if held is not None:
            yield held

    return run


def tree_merge(rows: DataFrame, keep: str = "max", node_bits: int | None = None, radix_bits: int = 4) -> DataFrame:
    """One row per digest: digest, check, length, keep_id, group_size.

    Entries merge only where digest, second hash and length all agree. ``keep`` is ``max`` or
    ``min``: which identifier is retained at every level. There are 2**node_bits nodes, by default
    as many as there are input partitions or up to twice as many.
    """
    if node_bits is None:
        node_bits = max(1, (rows.rdd.getNumPartitions() - 1).bit_length())
    schema = RUN.format(id=rows.schema["doc_id"].dataType.simpleString())
    order = ("node", *ENTRY)
    merged = lambda runs: runs.sortWithinPartitions(*order).mapInArrow(merger(keep), schema)
    bits = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    own = F.pmod(F.spark_partition_id(), F.lit(1 << node_bits)).cast("long")
    runs = merged(rows.select(own.alias("node"), *ENTRY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    for low in range(0, node_bits, radix_bits):
        mask = ((1 << min(radix_bits, node_bits - low)) - 1) << low
        node = F.col("node").bitwiseAND(F.lit(((1 << node_bits) - 1) & ~mask)).bitwiseOR(bits.bitwiseAND(F.lit(mask)))
        runs = merged(runs.withColumn("node", node).repartition(1 << node_bits, "node"))
    return runs.drop("node")


def exact_dedup(docs: DataFrame, keep: str = "max", hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty texts. Ties: rows that repeat a doc_id and text are one document, so all
    of them are marked kept if one is (``dedup`` returns it once). Null doc_ids never win over
    others; a group that has only null ids keeps them. An empty table gives no rows. Other columns
    of docs are not looked at.
    """
    rows = cut(digests(docs), "digests")
    groups = cut(tree_merge(rows, keep), "groups")
    least = F.lit(groups.agg(F.sum("group_size")).first()[0] or 0)
    frequent = groups.filter(F.col("group_size") * hot >= least)  # hot rows at most
    # frequent digests find their group by broadcast; the others by a join in which none of them takes part
    found = rows.join(F.broadcast(frequent), list(ENTRY))
    rest = rows.join(F.broadcast(frequent.select(*ENTRY)), list(ENTRY), "left_anti").join(groups.filter(F.col("group_size") * hot < least), list(ENTRY))
    return found.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns; each text once.

    The texts move once, dealt out by doc_id. Of rows that repeat a doc_id and an equal text, one stays.
    """
    rows = cut(digests(docs), "digests")
    groups = cut(tree_merge(rows, keep), "kept")
    names = {c: f"_d_{c}" for c in docs.columns}  # so that no column of docs clashes
    normal = ascii_lower(F.coalesce(F.col("_d_text"), F.lit("")))
    left = docs.withColumnsRenamed(names).withColumn("_digest", F.sha2(F.encode(normal, "utf-8"), 256))
    kept = left.join(groups, left["_d_doc_id"].eqNullSafe(groups["keep_id"]) & (left["_digest"] == groups["digest"]), "left_semi")
    n_kept = rows.join(groups, rows["doc_id"].eqNullSafe(groups["keep_id"]) & (rows["digest"] == groups["digest"]), "left_semi").count()
    if n_kept > groups.count():  # some rows repeat both doc_id and text
        once = Window.partitionBy("_d_doc_id", "_digest").orderBy(F.xxhash64(*names.values()))
        kept = kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.select(*[F.col(v).alias(k) for k, v in names.items()])
