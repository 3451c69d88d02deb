"""LM scoring: stupid-backoff scores, from n-gram counts of the whole corpus.

The count table is partitioned by n-gram and joined to the n-grams of the documents. A task adds up
the n-grams of each block of documents (a few MB that it reads together), so an n-gram comes to its
partition once from each block, however often and in how many documents of the block it occurs.
There the counts are summed and go back to the blocks that asked, where every document's scores are
made and summed. No table is broadcast.

Words first, then pairs, then triples: a round for each length. Those found in more than one block
are numbered, and a longer n-gram is asked for as (number of all but its last word, number of its last word):
a pair of numbers that stands for the words exactly, so nothing merges by chance, and the partition
is a permutation of that pair cut into equal ranges. What occurs in one block only is known there,
and no longer n-gram that holds it can occur in another block, so it is not asked for: both cuts
lose nothing. What a block and a partition send each other is one row with sorted numbers as gaps.

A document is scored by the counts of all others: its own occurrences are taken off first
(otherwise no n-gram would ever be unseen). For a word after its m - 1 predecessors in the document,
m at most ``order``: the first k from m down to 2 whose n-gram was seen gives
ALPHA**(m - k) * count(n-gram) / count(its first k - 1 words); if none was, ALPHA**(m - 1) *
count(word) / words in the other documents, with ALPHA for the count of a word never seen.

Cost: blocks are written once, bucketed by their number, and don't move; each round reads them again.
Numbers of a pair must fit 63 bits together (some 2**36 pairs of words by 2**27 words), else an error is raised.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, shared_dir, slices

ALPHA = 0.4
BLOCK_BYTES = 8 << 20
MAX_BUCKETS = 100_000  # of a table, Spark's own limit
STATE = "block long, doc_ids binary, null_ids binary, sizes binary, codes binary, words binary, lengths binary, places binary"
ASKED = "part int, block long, grams binary, n binary"
ANSWER = "block long, level int, part int, shared binary, ranks binary, totals binary, top long"


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0, byte by byte of their significance, compressed."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<IB", len(values), width) + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size, width = struct.unpack_from("<IB", data)
    planes = pa.decompress(memoryview(data)[5:], size * width, "zstd", asbytes=True)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size).T
    return out.view("<u8").ravel()


def pack_words(words: list[bytes]) -> bytes:
    joined = b" ".join(words)
    return struct.pack("<I", len(joined)) + pa.Codec("zstd", 6).compress(joined, asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    return pa.decompress(memoryview(data)[4:], struct.unpack_from("<I", data)[0], "zstd", asbytes=True).split()


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index of each distinct value, in their order; the place in it of every value; how often each occurs."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(new) - 1
    return order[starts], places, np.diff(starts, append=len(values))


def code_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each word's place in them, and each text's number of words."""
    data = pa.array([(t or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES) for t in texts], pa.large_binary())
    lists = pc.split_pattern(data, b" ")
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    coded = flat.filter(keep).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(upto[np.concatenate([[0], ends])])


def blocks(n_parts: int, block_bytes: int):
    """For each block one row: its documents as words numbered by falling frequency, its words in the order of asking, and the place in that order of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, most=block_bytes)):
            words, codes, sizes = code_words(batch.column("text").to_pylist())
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            parts = np.array([zlib.crc32(w) % n_parts for w in words.to_pylist()], np.int64)
            order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
            order = order[np.argsort(parts[order], kind="stable")]
            places = np.empty(len(words), np.int64)
            places[rank[order]] = np.arange(len(words))
            ids = batch.column("doc_id")
            row = {
                "block": task << 24 | number, "doc_ids": pack(ids.fill_null(0).to_numpy().view(np.uint64)), "null_ids": pack(ids.is_null().to_numpy(zero_copy_only=False)),
                "sizes": pack(sizes), "codes": pack(rank[codes]), "words": pack_words(words.take(pa.array(order)).to_pylist()),
                "lengths": pack(np.bincount(parts, minlength=n_parts)), "places": pack(places),
            }
            yield pa.RecordBatch.from_pylist([row])

    return run


def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first round: for each block and partition the block's words there and their counts."""
    for row in rows_of(batches):
        words, lengths, places = unpack_words(row["words"]), unpack(row["lengths"]).astype(np.int64), unpack(row["places"]).astype(np.int64)
        n = np.empty(len(words), np.int64)
        n[places] = np.bincount(unpack(row["codes"]).astype(np.int64), minlength=len(words))
        starts = np.cumsum(lengths) - lengths
        for part in np.flatnonzero(lengths).tolist():
            own = slice(starts[part], starts[part] + lengths[part])
            yield pa.RecordBatch.from_pylist([{"part": part, "block": row["block"], "grams": pack_words(words[own]), "n": pack(n[own] - 1)}], ASKED_ARROW)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


ASKED_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
ANSWER_ARROW = pa.schema(
    [("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("shared", pa.binary()), ("ranks", pa.binary()), ("totals", pa.binary()), ("top", pa.int64())]
)


def answer(level: int, longest: int):
    """A partition of the count table: sums its n-grams, numbers those of several blocks (but the longest), tells each block which of its own these are."""

    def run(group: pa.Table) -> pa.Table:
        sent = group.column("grams").to_pylist()
        if level == 1:
            lists = [unpack_words(g) for g in sent]
            coded = pa.array([w for ws in lists for w in ws], pa.large_binary()).dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            places = rank[coded.indices.to_numpy()]
        else:
            lists = [np.cumsum(unpack(g)) for g in sent]
            _, places, _ = grouped(np.concatenate(lists))
        n = np.concatenate([unpack(x) for x in group.column("n").to_pylist()]).astype(np.int64) + 1
        totals = np.zeros(int(places.max()) + 1, np.int64)
        np.add.at(totals, places, n)  # bincount would add them up as doubles
        many = np.bincount(places) > 1
        numbers = np.cumsum(many) - 1
        rows, start = [], 0
        for block, grams in zip(group.column("block").to_pylist(), lists, strict=True):
            here = places[start : start + len(grams)]
            start += len(grams)
            shared = many[here]
            ranks = numbers[here[shared]]
            rows.append(
                {
                    "block": block, "level": level, "part": group.column("part")[0].as_py(), "shared": pack(np.packbits(shared)),
                    "ranks": pack(np.diff(ranks, prepend=0)) if level < longest else None, "totals": pack(totals[here[shared]]), "top": int(numbers[-1]) + 1,
                }
            )
        return pa.Table.from_pylist(rows, ANSWER_ARROW)

    return run


class Block:
    """A block's documents and its n-grams, length by length, with what the count table told of them."""

    def __init__(self, row: dict, answers: pa.Table, n_parts: int, tops: list[int]):
        self.codes, self.sizes = unpack(row["codes"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
        self.places = unpack(row["places"]).astype(np.int64)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.within = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.answers: dict[int, dict[int, dict]] = {}
        for told in answers.to_pylist():
            self.answers.setdefault(told["level"], {})[told["part"]] = told
        self.n_parts, self.tops, self.n_words = n_parts, tops, len(self.places)

    def grow(self, level: int) -> None:
        """The distinct n-grams of that length, and those asked for, in the order of asking."""
        if level == 1:
            self.at, first = self.codes, np.arange(self.n_words)
            self.asked = np.empty(self.n_words, np.int64)
            self.asked[self.places] = first
            self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        else:
            ends = np.flatnonzero(self.within >= level - 1)
            first, place, _ = grouped(self.at[ends - 1] * self.n_words + self.codes[ends])
            at = np.full(len(self.codes), -1, np.int64)
            at[ends] = place
            first = ends[first]
            head, tail, word = self.numbers[self.at[first - 1]], self.numbers[self.at[first]], self.word_numbers[self.codes[first]]
            self.asked = np.flatnonzero((head >= 0) & (tail >= 0) & (word >= 0))
            mixed, width = self.mix(level, head[self.asked], word[self.asked])
            order = np.argsort(mixed)
            self.asked, self.mixed = self.asked[order], mixed[order]
            self.starts = np.searchsorted(self.mixed // np.uint64(width), np.arange(self.n_parts + 1).astype(np.uint64))
            self.at = at
        self.n = np.bincount(self.at[self.at >= 0], minlength=len(first))

    def mix(self, level: int, head: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, int]:
        """A permutation of the pairs of numbers, and the width of a partition's range in it."""
        bits = max(1, (self.tops[level - 2] * self.tops[0]).bit_length())
        if bits > 63:
            raise OverflowError(f"{self.tops[level - 2]} n-grams and {self.tops[0]} words of several blocks: their pairs don't fit 63 bits")
        pairs = head.astype(np.uint64) * np.uint64(self.tops[0]) + word.astype(np.uint64)
        mixed = pairs * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << bits) - 1)
        return mixed, -(-(1 << bits) // self.n_parts)

    def hear(self, level: int) -> None:
        """Numbers (-1: in this block only) and totals of the n-grams of that length."""
        self.numbers, self.totals = np.full(len(self.n), -1, np.int64), self.n.copy()
        for part, told in self.answers.get(level, {}).items():
            own = self.asked[self.starts[part] : self.starts[part + 1]]
            shared = np.unpackbits(unpack(told["shared"]).astype(np.uint8), count=len(own)).astype(bool)
            if told["ranks"] is not None:
                self.numbers[own[shared]] = np.cumsum(unpack(told["ranks"])).astype(np.int64) * self.n_parts + part
            if told.get("totals") is not None:
                self.totals[own[shared]] = unpack(told["totals"]).astype(np.int64)
        if level == 1:
            self.word_numbers = self.numbers


def ask(level: int, n_parts: int, tops: list[int]):
    """A later round: for each block and partition the block's n-grams there, as gaps between mixed pairs of numbers, and their counts."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in state.to_pylist():
            block = Block(row, answers, n_parts, tops)
            for k in range(1, level):
                block.grow(k)
                block.hear(k)
            block.grow(level)
            for part in np.flatnonzero(np.diff(block.starts)).tolist():
                own = slice(block.starts[part], block.starts[part + 1])
                gaps = np.diff(block.mixed[own], prepend=np.uint64(0))
                rows.append({"part": part, "block": row["block"], "grams": pack(gaps), "n": pack(block.n[block.asked[own]] - 1)})
        return pa.Table.from_pylist(rows, ASKED_ARROW)

    return run


RESULT = "doc_id long, n_words long, partial double, n_single long"


def score_block(order: int, n_parts: int, tops: list[int]):
    """The sums of a block's documents, but for the number of words in the corpus, which n_single terms divide by."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        block = Block(row, answers, n_parts, tops)
        codes, sizes = block.codes, block.sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        counts = []  # of the n-gram that ends at each word, in all other documents
        for k in range(1, order + 1):
            block.grow(k)
            block.hear(k)
            has = np.flatnonzero(block.at >= 0)
            has = has[block.totals[block.at[has]] > 1]  # one that occurs once in all is in no other document
            _, same, here = grouped(doc[has] * max(1, len(block.n)) + block.at[has])
            c = np.zeros(len(codes), np.int64)
            c[has] = block.totals[block.at[has]] - here[same]
            counts.append(c)
        most = np.minimum(block.within + 1, order)
        single = counts[0]
        value = np.log(np.where(single > 0, single, ALPHA)) + (most - 1) * np.log(ALPHA)
        backed = np.ones(len(codes), bool)
        for k in range(2, order + 1):
            seen = counts[k - 1] > 0
            before = np.zeros(len(codes), np.int64)
            before[1:] = counts[k - 2][:-1]
            value[seen] = np.log(counts[k - 1][seen] / before[seen]) + (most[seen] - k) * np.log(ALPHA)
            backed &= ~seen
        doc_ids = pa.array(unpack(row["doc_ids"]).view(np.int64), mask=unpack(row["null_ids"]).astype(bool))
        return pa.table(
            {
                "doc_id": doc_ids, "n_words": pa.array(sizes, pa.int64()),
                "partial": pa.array(np.bincount(doc, value, minlength=len(sizes)), pa.float64()), "n_single": pa.array(np.bincount(doc, backed, minlength=len(sizes)).astype(np.int64), pa.int64()),
            }
        )

    return run


def lm_scores(docs: DataFrame, order: int = 3, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_single, log_score, mean_log_score for every document.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. log_score is the sum
    of the logarithms; n_single says how many words were scored without their predecessors.
    Documents without words (null or empty texts among them) have log_score 0 and a null mean. In a
    corpus of one document nothing was ever seen, and the number of other words counts as 1. Very
    long texts are scored whole; rows that repeat a doc_id or a text are documents of their own; an
    empty table gives no rows. The count table has one partition for each ``bucket_bytes`` of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // bucket_bytes))
    name = f"annals_lm_blocks_{uuid.uuid4().hex}"
    # as many buckets as a shuffle has partitions at least, so that blocks stay where they are when answers come to them
    n_buckets = min(MAX_BUCKETS, max(-(-size // BLOCK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    made = rows.mapInArrow(blocks(n_parts, BLOCK_BYTES), STATE)
    made.write.bucketBy(n_buckets, "block").option("path", f"{shared_dir(spark)}/annals/{name}").saveAsTable(name)
    try:
        state = spark.table(name)
        told, tops = None, []
        for level in range(1, order + 1):
            if level == 1:
                asked = state.mapInArrow(ask_words, ASKED)
            else:
                numbers = told.drop("totals")  # these are for the scores
                asked = state.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(ask(level, n_parts, tops), ASKED)
            new = cut(asked.groupBy("part").applyInArrow(answer(level, order), ANSWER), f"lm-counts-{level}")
            told = new if told is None else told.unionByName(new)
            # numbers of this length are below: the most of a partition, times the number of partitions
            tops = [*tops, (new.agg(F.max("top")).first()[0] or 0) * n_parts]
        found = cut(state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score_block(order, n_parts, tops), RESULT), "lm-scores")
    finally:
        spark.sql(f"drop table if exists {name}")
    all_words = found.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(1), F.lit(all_words) - F.col("n_words"))
    log_score = F.col("partial") - F.col("n_single") * F.log(others)
    return found.select(
        "doc_id", "n_words", "n_single", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score")
    )
