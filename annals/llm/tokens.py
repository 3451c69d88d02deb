"""Whole-text encoding with a public tokenizer, and its ids as Simple-8b blocks in files.

The tokenizers library encodes texts. Text is encoded piecewise where that provably gives the same
ids: a single blank between two non-blank characters always starts a new pre-token of byte-level
tokenizers, so the ids of a text are those of its pieces, each with its leading blank, one after
the other; the same holds for a single line end between two non-blank characters, and marks at the
end of a word are a pre-token of their own. Pieces repeat, so a worker keeps the ids of those it has
met (the table is emptied when it has CACHE_PIECES).
Texts with any other white space are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

CACHE_PIECES = 600_000
MARKS = ".,;:!?"
BLOCK_IDS = 1 << 18  # ids in a row of the file, but for a single longer document
SUB_BLOCK = 1024  # ids between two offsets


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte, by the known rule:
    printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.line = self.tok.token_to_id(chr(self.letters[10]))  # the line end's own token
        self.clear()

    def clear(self) -> None:
        """Code 0 is no ids; -1 is a piece that makes its text be encoded whole."""
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.n = 1

    def _own_ids(self, piece: str) -> list[int]:
        """A piece that starts with a line end follows one, one that starts with a blank follows a word, others follow a blank."""
        text = piece[1:] if piece[0] in "\n " else piece
        lead = "" if piece[0] in "\n " else " "
        if text.isalpha() and text.isascii() or text.isalpha() and max(text) < "\u0250":  # letters alone are one pre-token
            model = (lead + text).encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tok.model.tokenize(model)]
        else:
            ids = self.tok.encode(lead + text, add_special_tokens=False).ids
        return [self.line, *ids] if piece[0] == "\n" else ids

    def _learn(self, new: list[str]) -> None:
        sizes, flat = [], []
        for p in new:
            own = self._own_ids(p)
            sizes.append(len(own))
            flat += own
        at, ends = self.starts[self.n], np.cumsum(sizes)
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(flat)), np.uint32)])
        if self.n + len(new) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(new)), np.int64)])
        self.ids[at : at + len(flat)] = flat
        self.known.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.starts[self.n + 1 : self.n + 1 + len(new)] = at + ends
        self.n += len(new)

    def _codes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Two codes for each distinct piece: its word, and the marks at the word's end if they aren't part of a known piece."""
        codes, marks = list(map(self.known.get, pieces)), np.zeros(len(pieces), np.int64)
        missing, cores, tails, new = [i for i, c in enumerate(codes) if c is None], [], [], {}
        for i in missing:
            p = pieces[i]
            text = p[1:] if p[:1] == "\n" else p
            core, tail = p, None
            if not text or text.split() != [text]:
                self.known[p] = -1
            else:
                own = p.rstrip(MARKS)
                if len(own) < len(p) and own and own[-1] < "\u0250" and own[-1].isalnum():
                    core, tail = own, " " + p[len(own) :]  # marks at the end of a word are a pre-token of their own
                for x in (core, tail):
                    if x and x not in self.known:
                        new[x] = None
            cores.append(core)
            tails.append(tail)
        if new:
            self._learn(list(new))
        for i, core, tail in zip(missing, cores, tails, strict=True):
            codes[i] = self.known[core]
            if tail:
                marks[i] = self.known[tail]
        return np.array(codes, np.int64), marks

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's ids."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.known) > CACHE_PIECES:
            self.clear()
        # the first piece takes a line end, and its id is taken off again
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", texts, "\n"), "\n", " \n"), " ")
        pieces = lists.flatten()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        coded = pieces.dictionary_encode()
        codes, marks = self._codes(coded.dictionary.to_pylist())
        of = coded.indices.to_numpy()
        codes, marks = codes[of], marks[of]
        heads = np.concatenate([[0], ends[:-1]])
        # each text begins with an empty piece, before the line end that was put there
        codes[heads] = 0
        odd = self.line is None or np.add.reduceat(codes < 0, heads) > 0
        odd = np.broadcast_to(odd, len(texts)).copy()
        codes = np.stack([codes, marks], axis=1).ravel()
        codes[codes < 0] = 0
        first = self.starts[codes]
        size = self.starts[codes + 1] - first
        size[codes == 0] = 0
        lead = 2 * (heads + 1)
        first[lead] += 1
        size[lead] = np.maximum(size[lead] - 1, 0)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        at = total[2 * np.concatenate([[0], ends])]
        lengths = np.diff(at)
        if odd.any():
            out = []
            for i, whole in enumerate(odd.tolist()):
                if whole:
                    own = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                    lengths[i] = len(own)
                    out.append(own)
                else:
                    out.append(ids[at[i] : at[i + 1]])
            ids = np.concatenate(out)
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """end_id after each document."""
    ends = np.cumsum(lengths)
    return np.insert(ids, ends, np.uint32(end_id)), lengths + 1


# --- Simple-8b -------------------------------------------------------------------------------
# A 64-bit word: the selector in the top 4 bits, then equal fields from the low bits on.
# Selector 0 is the escape: the next word holds one value of more than 60 bits as it is.
# Selector 1 is a run of zeros. Number and width of the fields by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and where each sub-block of SUB_BLOCK values starts in them.

    Each word takes as many of the next values as any selector allows: sliding maxima of the widths
    say which selectors do at every place; then sub-blocks advance side by side, a word at a time.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    width = np.zeros(n, np.uint8)
    for b in (0, *WIDTHS[2:].tolist()):
        width += values > np.uint64((1 << b) - 1)  # the number of listed widths that don't do
    lanes = -(-n // SUB_BLOCK)
    # sliding maxima of the widths in rows of a sub-block; beyond its end nothing fits
    most = np.full((lanes, SUB_BLOCK + 128), 255, np.uint8)
    for i in range(0, n, SUB_BLOCK * 1024):
        k = -(-len(width[i : i + SUB_BLOCK * 1024]) // SUB_BLOCK)
        padded = np.full(k * SUB_BLOCK, 255, np.uint8)
        padded[: len(width[i : i + k * SUB_BLOCK])] = width[i : i + k * SUB_BLOCK]
        most[i // SUB_BLOCK : i // SUB_BLOCK + k, :SUB_BLOCK] = padded.reshape(k, SUB_BLOCK)
    power, chosen = {1: most}, np.zeros((lanes, SUB_BLOCK), np.uint8)
    for p in (2, 4, 8, 16, 32, 64):
        half = power[p // 2]
        power[p] = np.maximum(half[:, : half.shape[1] - p // 2], half[:, p // 2 :])
    for k in range(15, 0, -1):
        c = int(COUNTS[k])
        p = 1 << (c.bit_length() - 1)
        over = np.maximum(power[p][:, :SUB_BLOCK], power[p][:, c - p : c - p + SUB_BLOCK])
        chosen[over <= k - 1] = k  # selectors that pack more come later and win
    chosen = chosen.ravel()
    step = COUNTS[chosen]
    pos, live, places, owner = np.arange(0, n, SUB_BLOCK), np.arange(lanes), [], []
    end = np.minimum(pos + SUB_BLOCK, n)
    while len(live):
        places.append(pos)
        owner.append(live)
        pos = pos + step[pos]
        more = pos < end[live]
        pos, live = pos[more], live[more]
    places, owner = np.concatenate(places), np.concatenate(owner)
    order = np.argsort(places, kind="stable")
    places, owner = places[order], owner[order]
    selector = chosen[places].astype(np.int64)
    at = np.arange(len(places)) + np.cumsum(selector == 0) - (selector == 0)  # an escape takes two words
    words = np.zeros(len(places) + int((selector == 0).sum()), np.uint64)
    words[at] = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        if s == 0:
            words[at[of] + 1] = values[places[of]]
        elif s > 1:
            field = values[places[of]].copy()
            for k in range(1, int(COUNTS[s])):
                field |= values[places[of] + k] << np.uint64(k * int(WIDTHS[s]))
            words[at[of]] |= field
    sizes = np.bincount(owner, 1 + (selector == 0), minlength=lanes).astype(np.int64)
    return words, (np.cumsum(sizes) - sizes).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values again: all words of one selector at a time."""
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    starts = selector == 0
    if starts.any():  # the word after an escape is a value; offsets always stand on a selector
        raw, escaped, i = np.zeros(len(words), bool), np.flatnonzero(starts), -2
        for x in escaped.tolist():
            if x != i + 1:
                i = x
                raw[x + 1] = True
    else:
        raw = np.zeros(len(words), bool)
    counts = np.where(raw, 0, COUNTS[selector])
    at = np.cumsum(counts) - counts
    # the number of values: the last word is as full as its selector says, except that words never pass a sub-block
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        of = np.flatnonzero((selector == s) & ~raw)
        if len(of):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            field = (words[of][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
            out[at[of][:, None] + np.arange(COUNTS[s])] = field
    of = np.flatnonzero(starts & ~raw)
    out[at[of]] = words[of + 1] if len(of) else 0
    return out


SCHEMA = "part int, block int, first long, doc_ids array<long>, n_tokens array<long>, offsets binary, words binary"


def block_writer(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the file for a partition whose documents are in order; first counts ids within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            nonlocal block, first, held
            docs = [d for h in held for d in h[0]]
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            words, offsets = pack(ids)
            row = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                    "offsets": pa.array([offsets.astype("<u4").tobytes()], pa.binary()), "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                }
            )
            block, first, held = block + 1, first + int(lengths.sum()), []
            return row

        for batch in slices(batches):
            ids, lengths = with_end(*enc.encode(batch.column("text")), end_id)
            held.append((batch.column("doc_id").to_pylist(), ids, lengths))
            if sum(len(h[1]) for h in held) >= BLOCK_IDS:
                yield emit()
        if held:
            yield emit()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of docs to a folder of files.

    The format: Parquet files whose rows are blocks. part and block number them in ascending
    doc_id order; first is the number of ids of the part before the block; doc_ids and n_tokens
    list its documents; words are Simple-8b words, little-endian, and offsets the place in words at
    which each run of 1,024 ids starts, so that runs decode apart from each other. Null texts count
    as empty; null doc_ids come first; rows that repeat a doc_id follow each other, ordered by a hash of the text.
    Documents are dealt out by ranges of doc_id and never split over blocks; an empty table gives
    files without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows.mapInArrow(block_writer(tokenizer or default_path(), end_id), SCHEMA).write.parquet(path)


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["n_tokens"], np.int64)
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4"))[: lengths.sum()].astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([row["part"]] * len(lengths), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "within": pa.array(starts + row["first"], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                }
            )


def digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in decode_blocks(batches):
        crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit; with digest: ids_crc32) of every document in the files.

    start is the number of ids of all documents before it, from the parts' totals: one small row for each part.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = files.groupBy("part").agg(F.sum(total).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = files.select(*files.columns)
    if digest:
        rows = rows.mapInArrow(digest_blocks, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    else:
        rows = rows.mapInArrow(decode_blocks, "part int, doc_id long, within long, n_tokens long, ids binary")
    last = rows.columns[-1]
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last)
