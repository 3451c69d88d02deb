"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are dealt into groups by a seeded hash, about ``group_docs`` to a group, so that groups
are alike, independent and small enough for a task whatever the table's size. In a group, documents
of more than a sequence give full sequences first; what is left of each document is placed, longest
first, into the first sequence with room, which a tournament tree over the free room finds in
logarithmic time. Then the emptiest sequences are cut up to fill gaps of at least MIN_CUT tokens in
the others, and the one that stays partly filled is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import default_path, encoder, with_end

MIN_CUT = 16


class Room:
    """Free room of bins as a tournament: each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for size; takes that room."""
        most, i = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i = 2 * i if most[2 * i] >= size else 2 * i + 1
        most[i] -= size
        found = i - self.leaves
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; ties in size go by place in the list."""
    room, out = Room(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = room.first(sizes[i])
    return out


def pack_group(lengths: list[int], capacity: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id of the documents once."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    bins: list[list[tuple[int, int, int]]] = []
    for piece, b in zip(rest, first_fit_decreasing([r[2] for r in rest], capacity), strict=True):
        bins += [[] for _ in range(b + 1 - len(bins))]
        bins[b].append(piece)
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted((i for i in range(len(bins)) if capacity - fill[i] >= MIN_CUT), key=lambda i: (-fill[i], i))
    to, of = 0, len(order) - 1
    while to < of:
        i, j = order[to], order[of]
        doc, start, n = bins[j].pop()
        take = min(n, capacity - fill[i])
        bins[i].append((doc, start, take))
        fill[i] += take
        fill[j] -= take
        if take < n:
            bins[j].append((doc, start + take, n - take))
        to += capacity - fill[i] < MIN_CUT
        of -= not bins[j]
    out = full
    for b, n in zip(bins, fill, strict=True):
        if capacity - n < MIN_CUT or n & (n - 1) == 0:
            out += [b] if b else []
            continue
        pieces = b[::-1]
        while n:
            own, left = [], 1 << (n.bit_length() - 1)
            n -= left
            while left:
                doc, start, size = pieces.pop()
                own.append((doc, start, min(size, left)))
                if size > left:
                    pieces.append((doc, start + left, size - left))
                left -= own[-1][2]
            out.append(own)
    return out


GROUPS_OF_TASK = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packer(path: str, end_id: int, capacity: int, ids: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        enc, parts, sizes = encoder(path), [], []
        for batch in slices(group.to_batches()):
            own, lengths = with_end(*enc.encode(batch.column("text").to_pylist()), end_id)
            parts.append(own.astype("<u4"))
            sizes.append(lengths)
        data, lengths = np.concatenate(parts), np.concatenate(sizes)
        begin = (np.cumsum(lengths) - lengths).tolist()
        doc_ids, base = group.column("doc_id").to_pylist(), group.column("_group")[0].as_py() << 24
        rows, held = [], []
        for k, sequence in enumerate(pack_group(lengths.tolist(), capacity)):
            offset = 0
            for doc, start, n in sequence:
                own = data[begin[doc] + start : begin[doc] + start + n].tobytes()
                rows.append((doc_ids[doc], start, n, zlib.crc32(own), int(lengths[doc]), base + k, offset))
                held.append(own if ids else None)
                offset += n
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = {name: pa.array(col, pa.int64()) for name, col in zip(names, zip(*rows, strict=True), strict=True)}
        return pa.table(out | ({"ids": pa.array(held, pa.binary())} if ids else {}))

    return run


def copies_apart(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with a column _copy that numbers rows which repeat both.

    Repeated rows are counted before they move, so that however many there are no task gathers them.
    """
    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    repeated = keyed.groupBy("doc_id", "_hash").count().filter("count > 1").select(F.col("doc_id").alias("_r_id"), F.col("_hash").alias("_r_hash"))
    if repeated.isEmpty():
        return rows.withColumn("_copy", F.lit(1).cast("long"))
    repeated = cut(repeated, "repeated")
    same = keyed["doc_id"].eqNullSafe(repeated["_r_id"]) & (keyed["_hash"] == repeated["_r_hash"])
    many = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    once = keyed.join(repeated, same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("_copy"))
    return once.union(many.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_copy")))


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, group_bytes: int = 2 << 20, seed: int = 17, ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ids also its ids, little-endian.

    A document is its text's ids and then end_id. Groups have about ``group_bytes`` of text; a longer
    document makes its group that long. Null and empty texts are end_id alone; null doc_ids and rows
    that repeat a doc_id are documents like others; ties in length go by doc_id and text; very long
    texts become full sequences and a rest; an empty table gives no rows. Other columns are not
    looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "_copy"), F.lit(groups))
    dealt = copies_apart(rows).select("doc_id", "text", group.alias("_group")).repartition(-(-groups // GROUPS_OF_TASK), "_group")
    run = packer(tokenizer or default_path(), end_id, capacity, ids)
    return dealt.groupBy("_group").applyInArrow(run, SCHEMA + (", ids binary" if ids else ""))
