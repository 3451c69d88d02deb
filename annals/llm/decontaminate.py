"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the benchmark items' windows of ``window`` words (an item with fewer is one pattern).
For each pattern length, a shift table over hashed blocks of two words says how far a search may
skip without missing an occurrence; where it says 0, the bucket of the block's hash names the
patterns that end in such a block, and comparing all their words confirms an occurrence. Many
stretches of text advance side by side in arrays.

The benchmark is cut into blocks of about ``block_bytes`` of text by a hash of its items. The tables of
each block are built once, in a task, and written to the shared folder. Every block then passes over
the documents on its own: its tables are broadcast, each worker unpacks them once, and they are given
up before the next block comes; what a pass finds (only documents with hits) is written down and
merged at the end. So driver and workers hold the tables of one block, however large the benchmark.
An item longer than block_bytes makes its block that long.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, slices

TABLE_BITS = 20
LANE = 256  # places that a stretch searches
MULTIPLIER = 0x9E3779B1


def block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) * MULTIPLIER + b) * MULTIPLIER >> 15) & ((1 << TABLE_BITS) - 1)


class Patterns:
    """Tables for all patterns of one length; words are numbers from 1 on, 0 is any word of no pattern."""

    def __init__(self, words: np.ndarray):
        self.words, self.m = words.astype(np.int32), words.shape[1]
        self.block = min(2, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.uint8 if self.m < 255 else np.int32)
        for end in range(self.block, self.m + 1):
            h = self.hash_at(words, end - 1)
            np.minimum.at(self.shift, h, np.array(self.m - end, self.shift.dtype))
        last = self.hash_at(words, self.m - 1)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.buckets, self.begin, self.size = np.unique(last[self.order], return_index=True, return_counts=True)

    def hash_at(self, words: np.ndarray, end: int) -> np.ndarray:
        return block_hash(words[:, end - 1] if self.block == 2 else np.zeros(len(words), np.int64), words[:, end])

    def find(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word's place, pattern) of every occurrence inside the documents text[begin:end]."""
        long = end - begin >= self.m
        first, stop = begin[long] + self.m - 1, end[long]
        lanes = -(-(stop - first) // LANE)
        offset = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cur = np.repeat(first, lanes) + offset * LANE
        stop = np.minimum(cur + LANE, np.repeat(stop, lanes))
        found = []
        while len(cur):
            h = block_hash(text[cur - 1] if self.block == 2 else np.zeros(len(cur), np.int64), text[cur])
            s = self.shift[h]
            hit = s == 0
            if hit.any():
                found.append((cur[hit], h[hit]))
            cur = cur + np.maximum(s, 1)
            live = cur < stop
            cur, stop = cur[live], stop[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = np.minimum(np.searchsorted(self.buckets, h), len(self.buckets) - 1)
        known = self.buckets[bucket] == h
        at, bucket = at[known] - self.m + 1, bucket[known]
        places, patterns = [], []
        for i in range(0, len(at), 1 << 14):
            a, b = at[i : i + (1 << 14)], bucket[i : i + (1 << 14)]
            size = self.size[b]
            which = self.order[np.repeat(self.begin[b] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            a = np.repeat(a, size)
            for k in range(self.m):  # direct comparison, word by word
                same = text[a + k] == self.words[which, k]
                a, which = a[same], which[same]
            places.append(a)
            patterns.append(which)
        return np.concatenate(places), np.concatenate(patterns)


class Search:
    """All patterns of a block of items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(self.names)}
        by_length: dict[int, tuple[list, list]] = {}
        for item, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)], np.int32)
            m = min(window, len(words))
            if m:
                rows, owners = by_length.setdefault(m, ([], []))
                rows.append(np.lib.stride_tricks.sliding_window_view(words, m))
                owners.append(np.full(len(words) - m + 1, -1 if item is None else number[str(item)]))
        self.patterns = []
        for m, (rows, owners) in sorted(by_length.items()):
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1)
            pairs = pairs[:, pairs[1] >= 0]
            self.patterns.append((Patterns(distinct), np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]))

    def run(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray | None], list[set[str]]]:
        """By document: its hit words (None: none), and the items found."""
        get = self.vocabulary.get
        flat = np.concatenate([np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)) for ws in texts]) if texts else np.empty(0, np.int64)
        end = np.cumsum(np.array([len(ws) for ws in texts], np.int64))
        begin = end - np.array([len(ws) for ws in texts], np.int64)
        edge = np.zeros(len(flat) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        touched: set[int] = set()
        for patterns, starts, owners in self.patterns:
            at, which = patterns.find(flat, begin, end)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + patterns.m, -1)
            docs = np.searchsorted(end, at, side="right")
            touched |= set(docs.tolist())
            for doc, p in set(zip(docs.tolist(), which.tolist(), strict=True)):
                items[doc].update(self.names[o] for o in owners[starts[p] : starts[p + 1]].tolist())
        inside = np.cumsum(edge[:-1]) > 0
        return [inside[a:b] if d in touched else None for d, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True))], items


_TABLES: dict[str, Search] = {}


def unpacked(key: str, block) -> Search:
    """A worker holds the tables of one block."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = pickle.loads(block.value)
    return _TABLES[key]


FOUND = "n_words long, n_hit long, items array<string>, hit_words array<array<int>>"


def spans_of(hits: np.ndarray | None) -> list[list[int]]:
    if hits is None:
        return []
    step = np.diff(np.concatenate([[0], hits.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist()


def searcher(key: str, block, extra: list[str], text: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search the tables of one block; None: only count words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [alnum_words(t) for t in batch.column(text).to_pylist()]
            hits, items = unpacked(key, block).run(texts) if block is not None else ([None] * len(texts), [()] * len(texts))
            cols = {c: batch.column(c) for c in extra}
            cols["n_words"] = pa.array([len(t) for t in texts], pa.int64())
            cols["n_hit"] = pa.array([0 if h is None else int(h.sum()) for h in hits], pa.int64())
            cols["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            cols["hit_words"] = pa.array([spans_of(h) for h in hits], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def builder(window: int):
    def run(group: pa.Table) -> pa.Table:
        items = list(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True))
        return pa.table({"block": group.column("block").slice(0, 1), "tables": pa.array([pickle.dumps(Search(items, window), 5)], pa.binary())})

    return run


def block_tables(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, DataFrame]:
    """The number of blocks, and (block, tables) of each, built once and written down."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return n, cut(dealt.groupBy("block").applyInArrow(builder(window), "block long, tables binary"), "benchmark")


def merge_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as disjoint spans, and the number of words in them."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            hits = np.zeros(max(b for _, b in spans), bool)
            for a, b in spans:
                hits[a:b] = True
            merged.append(hits)
        cols = {c: batch.column(c) for c in ("_k_id", "_k_hash", "items")}
        cols["n_hit"] = pa.array([int(h.sum()) for h in merged], pa.int64())
        cols["hit_words"] = pa.array([spans_of(h) for h in merged], pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_pydict(cols)


def searched(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns of rows (text, by its name, and _k_id, which names a document, are among its columns) and FOUND."""
    context, schema = rows.sparkSession.sparkContext, {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields}
    n, built = block_tables(benchmark, window, block_bytes)

    def passed(block: int, columns: list[str]) -> tuple[DataFrame, object]:
        tables = built.filter(F.col("block") == block).select("tables").first()
        send = context.broadcast(bytes(tables[0]) if tables else pickle.dumps(Search([], window)))
        return rows.mapInArrow(searcher(uuid.uuid4().hex, send, columns, text), ", ".join([*(schema[c] for c in columns), FOUND])), send

    if n == 1:  # nothing to merge: a map over the rows as they are read
        return passed(0, carry)[0]
    rows, keys = rows.withColumn("_k_hash", F.xxhash64(text)), ["_k_id", "_k_hash"]
    schema["_k_hash"], hits = "_k_hash long", None
    for block in range(n):
        found, send = passed(block, keys)
        found = cut(found.filter("n_hit > 0").dropDuplicates(keys).select(*keys, "items", "hit_words"), "hits")
        send.destroy()
        hits = found if hits is None else hits.unionByName(found)
    lists = hits.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hit_words")).alias("spans"))
    merged = lists.mapInArrow(merge_hits, f"{schema['_k_id']}, _k_hash long, items array<string>, n_hit long, hit_words array<array<int>>")
    merged = merged.withColumnsRenamed({c: f"_m_{c}" for c in merged.columns})
    columns = [*dict.fromkeys([*carry, *keys])]
    all_rows = rows.mapInArrow(searcher("", None, columns, text), ", ".join([*(schema[c] for c in columns), FOUND]))
    both = all_rows.join(merged, all_rows["_k_id"].eqNullSafe(merged["_m__k_id"]) & (all_rows["_k_hash"] == merged["_m__k_hash"]), "left")
    return both.select(*carry, "n_words", *[F.coalesce(f"_m_{c}", c).alias(c) for c in ("n_hit", "items", "hit_words")])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids of items found, as sorted strings), hit_words ([begin, end) spans).

    Documents with null or empty texts or without words have no hits. Items without words match
    nothing; rows that repeat an item_id are one item; hits of items without id count, but have no
    name. With one block of benchmark no row moves: documents are searched where they are read. Rows
    that repeat a doc_id have rows of their own. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").alias("_k_id"), F.col("text").cast("string").alias("text"))
    return searched(rows, benchmark, window, block_bytes, ["_k_id"]).withColumnRenamed("_k_id", "doc_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document; see find_benchmark."""
    found = find_benchmark(docs, benchmark, window, block_bytes)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents in which no window occurs, with all their columns; with one block of benchmark a map over the rows as they are read."""
    names = {c: f"_d_{c}" for c in docs.columns}
    rows, text = docs.withColumnsRenamed(names).withColumn("_k_id", F.col("_d_doc_id")), "_d_text"
    if docs.schema["text"].dataType.typeName() != "string":  # else what is carried is searched: a text goes to Python once
        rows, text = rows.withColumn("text", F.col(text).cast("string")), "text"
    out = searched(rows, benchmark, window, block_bytes, list(names.values()), text)
    return out.filter("n_hit = 0").select(*[F.col(v).alias(k) for k, v in names.items()])
