"""Repeated byte strings by a distributed difference cover.

Wanted are all starts j whose LENGTH bytes also start earlier, in an earlier document or in the same
one. Suffixes are compared on their first LENGTH bytes only, so the recursion ends after two rounds.

1. Cover. Of the GRAM-byte strings within the LENGTH bytes from j, the one with the least hash (ties:
   leftmost) is the sample of j. It depends on those bytes alone, so equal strings have their samples
   at equal offsets, which is what a difference cover gives; a cover by residues would have to sort
   every position of the corpus (README). Neighbouring starts share samples: some 3 % of all
   positions are samples, each with an interval of starts.
2. Sampled triples. A sample stands for the bytes left of it, its gram and the bytes right of it, as
   far as its starts reach. Triples are sorted by the name of the gram, then by that of the whole.
   A gram that occurs once settles its starts: they are new. Of equal triples the first keeps its
   starts and the others' starts are repeats.
3. Recursion on names. A gram with several triples isn't settled: its first triples go on, with their
   bytes.
4. Merge and comparison. Their starts are the remaining suffixes: each is placed beside those of the
   same gram by its first LENGTH bytes, and neighbours with equal prefixes are compared; all but the
   earliest are repeats. Grams with more than WIDE triples are not one group: their starts are dealt
   by the name of their own LENGTH bytes.

Names are pairs of independent 64-bit hashes; in step 4 the bytes themselves are compared, but for the
starts of wide grams. Tasks drop what repeats within some 16 MB of text before they send, so a
passage or document that makes up a third of all rows is sent once for each 16 MB. Texts move once,
to meet their marks; they are not rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

LENGTH = 100
GRAM = 32
PIECE = 1 << 21  # bytes of text that are looked at together; longer texts go in overlapping pieces
SENT = 1 << 19  # samples between which repeats are dropped before they are sent
WIDE = 256
PLACE_BITS = np.uint64(24)
FIRST_ID = -(1 << 63)  # stands for a null doc_id

MARK = "doc long, tag long, lo int, hi int"


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """A polynomial hash of 64 bits with an odd base, of any stretch of bytes, from prefix sums."""

    def __init__(self, seed: int):
        base = int(scramble(np.array([seed], np.uint64))[0]) | 1
        self.letters = scramble(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

        def powers(b: int) -> np.ndarray:
            p = np.full(PIECE + LENGTH, b, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        self.up, self.down = powers(base), powers(pow(base, -1, 1 << 64))

    def sums(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.letters[x] * self.up[: len(x)], out=s[1:])
        return s

    def of(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return scramble((s[hi] - s[lo]) * self.down[lo])


ROLLING: list[Rolling] = []


def rolling() -> tuple[Rolling, Rolling]:
    if not ROLLING:
        ROLLING.extend((Rolling(0x51ED270B), Rolling(0xA3B19535)))
    return ROLLING[0], ROLLING[1]


def samples(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each sample, names of gram and triple, in texts that end at ``ends``, laid end to end."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    n = len(x)
    if n < LENGTH:
        return none
    a, b = rolling()
    s = a.sums(x)
    grams = scramble((s[GRAM:] - s[:-GRAM]) * a.down[: n - GRAM + 1])
    least = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.ones(n, bool)
    for e, size in zip(ends, np.diff(ends, prepend=0), strict=True):
        inside[e - min(size, LENGTH - 1) : e] = False
    at[~inside[: len(at)]] = -1
    lo = np.flatnonzero(np.diff(at, prepend=-2))
    hi = np.append(lo[1:], len(at)) - 1
    real = at[lo] >= 0
    lo, hi = lo[real], hi[real]
    if not len(lo):
        return none
    at = at[lo]
    triple = b.of(b.sums(x), lo, hi + LENGTH) + scramble((at - lo).astype(np.uint64))
    return lo, hi, grams[at], triple


def pieces(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """doc, tag, offset and bytes; pieces of a text overlap so that each start is in one of them."""
    for doc, tag, text in zip(*(part.column(c).to_pylist() for c in ("doc", "tag", "text")), strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE - LENGTH + 1):
            yield doc, tag, at, raw[at : at + PIECE]


def gathered(part_of: Iterator[tuple[int, int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    held, size = [], 0
    for p in part_of:
        if held and size + len(p[3]) > PIECE:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p[3])
    if held:
        yield held


def earliest(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows by keys, then place, and which of them, in that order, repeat an earlier place with equal keys."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if n else order
    other = np.zeros(n, bool)
    for p in place:
        p = p[order]
        other |= p != p[head] if n else False
    return order, other


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of samples: name of gram and triple, and the starts; those that repeat earlier ones of the same task have repeat set."""
    held: list[list[np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        name, triple, doc, tag, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        if tag.any():  # ids repeat: rows of one document are one
            once = np.unique(np.column_stack([doc, tag, lo]), axis=0, return_index=True)[1]
            name, triple, doc, tag, lo, hi = (c[once] for c in (name, triple, doc, tag, lo, hi))
        order, repeat = earliest([name, triple], [doc, tag, lo])
        name, triple, doc, tag, lo, hi = (c[order] for c in (name, triple, doc, tag, lo, hi))
        # repeats are settled: they go along under names that spread them
        name = np.where(repeat, scramble(doc.view(np.uint64) + scramble(lo.astype(np.uint64))), name)
        triple = np.where(repeat, np.uint64(0), triple)
        return pa.RecordBatch.from_pydict({"name": name.view(np.int64), "triple": triple.view(np.int64), "doc": doc, "tag": tag, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "repeat": repeat})

    waiting = 0
    for batch in batches:
        for part in slices([batch], most=PIECE):
            for group in gathered(pieces(part)):
                sizes = np.array([len(p[3]) for p in group])
                ends = np.cumsum(sizes)
                lo, hi, name, triple = samples(np.frombuffer(b"".join(p[3] for p in group), np.uint8), ends)
                which = np.searchsorted(ends, lo, "right")
                shift = (np.array([p[2] for p in group]) - (ends - sizes))[which]
                doc, tag = (np.array([p[k] for p in group], np.int64)[which] for k in (0, 1))
                held.append([name, triple, doc, tag, lo + shift, hi + shift])
                waiting += len(lo)
                if waiting >= SENT:
                    waiting = 0
                    yield rows()
    if held:
        yield rows()


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with marks: rows to compare. Those of a wide gram are single starts, named by their own bytes."""
    a, b = rolling()
    for part in slices(batches, most=PIECE):
        cold: list[tuple] = []
        wide: list[tuple] = []
        raw_wide: list[bytes] = []
        columns = (part.column(c).to_pylist() for c in ("doc", "tag", "text", "marks"))
        for doc, tag, text, marks in zip(*columns, strict=True):
            if not marks:
                continue
            raw = (text or "").encode("utf-8", "surrogatepass")
            for m in marks:
                if m["wide"]:
                    wide.append((doc, tag, m["lo"], m["hi"]))
                    raw_wide.append(raw[m["lo"] : m["hi"] + LENGTH])
                else:
                    cold.append((m["name"], 0, doc, tag, m["lo"], m["hi"], False, raw[m["lo"] : m["hi"] + LENGTH]))
        if cold:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cold, strict=True), TYPES, strict=True)], names=NAMES)
        step = PIECE // (2 * LENGTH)
        for k in range(0, len(wide), step):
            doc, tag, lo, hi = (np.array(c, np.int64) for c in zip(*wide[k : k + step], strict=True))
            x = np.frombuffer(b"".join(raw_wide[k : k + step]), np.uint8)
            times = hi - lo + 1
            size = times + LENGTH - 1
            each = np.repeat(np.arange(len(doc)), times)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            at = (np.cumsum(size) - size)[each] + nth
            key, check = (r.of(r.sums(x), at, at + LENGTH) for r in (a, b))
            doc, tag, start = doc[each], tag[each], lo[each] + nth
            order, repeat = earliest([key, check], [doc, tag, start])
            key, check, doc, tag, start = (c[order] for c in (key, check, doc, tag, start))
            key = np.where(repeat, scramble(doc.view(np.uint64) + scramble(start.astype(np.uint64))), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((key.view(np.int64), np.where(repeat, np.uint64(0), check).view(np.int64), doc, tag, start, start, repeat, [None] * len(doc)), TYPES, strict=True)], names=NAMES
            )


NAMES = ["key", "check", "doc", "tag", "lo", "hi", "repeat", "bytes"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of MARK, in which intervals of starts that follow each other are one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, last = (c[order] for c in (doc, tag, start, last))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), pa.array(start[at], pa.int32()), pa.array(last[end], pa.int32())], names=["doc", "tag", "lo", "hi"])


def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Repeats among the starts of whole grams: sorted by gram and hash of LENGTH bytes, neighbours compared byte by byte."""
    a, _ = rolling()
    raw = rows.column("bytes").to_pylist()
    key, doc, tag, lo, hi = (rows.column(c).to_numpy() for c in ("key", "doc", "tag", "lo", "hi"))
    k = 0
    while k < len(raw):
        size, n = 0, k  # whole grams, some PIECE bytes of them
        while n < len(raw) and (size < PIECE // 4 or key[n] == key[n - 1]):
            size += len(raw[n])
            n += 1
        part = slice(k, n)
        k = n
        x = np.frombuffer(b"".join(raw[part]), np.uint8)
        times = (hi[part] - lo[part] + 1).astype(np.int64)
        size = times + LENGTH - 1
        each = np.repeat(np.arange(len(times)), times)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        at = (np.cumsum(size) - size)[each] + nth
        names, docs, tags, starts = key[part][each], doc[part][each], tag[part][each], lo[part][each] + nth
        prefix = a.of(a.sums(x), at, at + LENGTH)
        order, _ = earliest([names, prefix], [docs, tags, starts])
        names, prefix, at = names[order], prefix[order], at[order]
        like = np.flatnonzero((names[1:] == names[:-1]) & (prefix[1:] == prefix[:-1]))
        windows = np.lib.stride_tricks.sliding_window_view(x, LENGTH)
        same = np.zeros(len(at), bool)
        for i in range(0, len(like), 4096):
            p = like[i : i + 4096]
            same[p + 1] = (windows[at[p]] == windows[at[p + 1]]).all(axis=1)
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        docs, tags, starts = docs[order], tags[order], starts[order]
        repeat = same & ((docs != docs[head]) | (tags != tags[head]) | (starts != starts[head]))
        if repeat.any():
            yield joined(docs[repeat], tags[repeat], starts[repeat], starts[repeat])


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats, from rows sorted by key, check, doc, tag and lo."""
    cold: pa.Table | None = None
    head: tuple | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        bare = rows.column("bytes").is_null()
        single = rows.filter(bare)
        if single.num_rows:
            key, check, doc, tag, lo, hi = (single.column(c).to_numpy() for c in NAMES[:6])
            repeat = single.column("repeat").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            if head and head[:2] == (key[0], check[0]):
                new[0] = False
            first = np.cumsum(new) - 1  # -1: the head that the last batch left
            at = np.flatnonzero(new)
            place = [np.where(first >= 0, c[at[np.maximum(first, 0)]] if len(at) else 0, h) for c, h in zip((doc, tag, lo), head[2:] if head else (0, 0, 0), strict=True)]
            if len(at):
                head = tuple(c[at[-1]] for c in (key, check, doc, tag, lo))
            repeat = repeat | (doc != place[0]) | (tag != place[1]) | (lo != place[2])
            if repeat.any():
                yield joined(doc[repeat], tag[repeat], lo[repeat], hi[repeat])
        own = rows.filter(pc.invert(bare))
        if own.num_rows:
            cold = own if cold is None else pa.concat_tables([cold, own])
            keys = cold.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last gram may go on
            if whole:
                yield from compared(cold.slice(0, whole))
                cold = cold.slice(whole).combine_chunks()
    if cold is not None and cold.num_rows:
        yield from compared(cold)


RESULT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the result, from texts with the intervals of their repeated starts."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for part in slices(batches):
        out = []
        for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for lo, hi in sorted((m["lo"], m["hi"]) for m in marks or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi + LENGTH)
                else:
                    spans.append([lo, hi + LENGTH])
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            out.append((len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), span))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_strings(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets of what is removed).

    Null texts are empty. Rows that repeat a doc_id and text are one document and get equal results;
    rows that repeat only the doc_id are ordered by a hash of their text. Null doc_ids come first. A
    text repeats itself too. Texts of fewer than LENGTH bytes keep all. An empty table gives no rows;
    other columns are not looked at. doc_id must be of an integer type. ``wide`` (at most 8,192) only
    says how the work is dealt out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    ids = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("m")).first()
    tag = F.lit(0).cast("long") if ids.n == ids.m else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), tag.alias("tag"), "text")

    triples = rows.mapInArrow(sampled, "name long, triple long, doc long, tag long, lo int, hi int, repeat boolean").repartition("name")
    gram, same = Window.partitionBy("name"), Window.partitionBy("name", "triple").orderBy("doc", "tag", "lo")
    named = triples.withColumn("place", F.rank().over(same)).select(
        "*", (F.min("triple").over(gram) != F.max("triple").over(gram)).alias("open"), F.count_if(F.col("place") == 1).over(gram).alias("triples")
    )
    repeat = F.col("repeat") | (F.col("place") > 1)
    marks = cut(named.filter(repeat | F.col("open")).select("doc", "tag", "lo", "hi", repeat.alias("repeat"), "name", (F.col("triples") > wide).alias("wide")), "marks")

    by_doc = ["doc"] if ids.n == ids.m else ["doc", "tag"]
    unsettled = marks.filter("not repeat").groupBy(by_doc).agg(F.collect_list(F.struct("lo", "hi", "name", "wide")).alias("marks"))
    # both joins read the same columns of the texts, so that one exchange of them serves both
    compare = rows.join(unsettled, by_doc, "left").select("doc_id", "doc", "tag", "text", "marks").mapInArrow(contexts, "key long, check long, doc long, tag long, lo int, hi int, repeat boolean, bytes binary")
    found = compare.repartition("key").sortWithinPartitions("key", "check", "doc", "tag", "lo").mapInArrow(settled, MARK)
    repeats = marks.filter("repeat").select("doc", "tag", "lo", "hi").unionByName(found)
    gone = repeats.groupBy(by_doc).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return rows.join(gone, by_doc, "left").select("doc_id", "text", "marks").mapInArrow(removed, RESULT.format(id=id_type))
