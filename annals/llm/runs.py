"""Periodic runs of words by grammar compression.

A run is a maximal stretch of words with smallest period q that is at least LEAST words and POWER
periods long. Tasks work on bounded slices of documents; nothing moves between them.

1. Stretches in which a run can lie: all but the last q + 1 words of a run start a pair of words that
   recurs within q words, so for each power of two D the stretches of pairs that recur within D are
   taken if they are long enough for a period in (D/2, D], and lengthened by D + 1 words. Prose has
   hardly any.
2. Re-Pair on these stretches, in rounds: of overlapping pairs of symbols that occur at least twice
   the more frequent (by powers of two, then by a shuffled order) becomes a nonterminal, at all places
   where it wins, until no pair occurs twice. What is left of each stretch is joined by a balanced
   tree. Each nonterminal keeps one place of its expansion and all positions at which it was made.
3. Runs that cross the boundary of a nonterminal, once for each: a period q needs a square of q on one
   side of the boundary, which three words tell mostly; its extent is then compared word by word
   within the expansion. A period that is a multiple of a found one is skipped.
4. Runs are translated to all positions of their nonterminal. A maximal run is found whole at the
   lowest nonterminal that holds it, so intervals that lie in another one of equal period are pieces
   of it and go.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

LEAST, POWER = 6, 4
CHUNK = 1 << 20  # pairs of boundary and period that are looked at together

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches [start, end) that hold all runs; ``ends`` are the ends of the documents."""
    n = len(ids)
    if n < LEAST:
        return []
    code = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    inner = np.ones(n - 1, bool)
    inner[ends[ends < n] - 1] = False  # pairs over two documents
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.flatnonzero(inner)
    order = order[np.argsort(code[order], kind="stable")]
    gap = np.full(n, n + 1)
    a, b = order[:-1], order[1:]
    again = (code[a] == code[b]) & (doc[a] == doc[b])
    gap[a[again]] = (b - a)[again]
    longest = int(np.diff(ends, prepend=0).max())
    found, near = [], 1
    while near == 1 or POWER * (near // 2 + 1) <= longest:
        mask = np.concatenate(([0], gap <= near, [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(mask)).reshape(-1, 2)
        # a run of q words has its length less q + 1 such pairs, at least
        least = LEAST - 2 if near == 1 else (POWER - 1) * (near // 2 + 1) - 1
        edges = edges[edges[:, 1] - edges[:, 0] >= least]
        found += [(int(s), int(min(e + near + 1, ends[doc[s]]))) for s, e in edges]
        near *= 2
    merged: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


class Grammar:
    """Nonterminals of the stretches: for each the place of one expansion, its boundary, its length and all positions."""

    def __init__(self, ids: np.ndarray, spans: list[tuple[int, int]]):
        self.at = np.concatenate([np.arange(s, e) for s, e in spans])
        self.seg = np.repeat(np.arange(len(spans)), [e - s for s, e in spans])
        self.sym = np.unique(ids[self.at], return_inverse=True)[1].astype(np.int64)
        self.len = np.ones(len(self.at), np.int64)
        self.symbols = int(self.sym.max()) + 1
        self.first: list[np.ndarray] = []  # by round: place, left length, length; then positions and whose they are
        self.left: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.whose: list[np.ndarray] = []
        self.made = 0
        while self.repair():
            pass
        while self.join():
            pass

    def replace(self, picked: np.ndarray, code: np.ndarray) -> None:
        """Symbols at picked and after become one; code says which are the same."""
        _, first, new = np.unique(code, return_index=True, return_inverse=True)
        head = picked[first]
        both = self.len[picked] + self.len[picked + 1]
        self.first.append(self.at[head])
        self.left.append(self.len[head])
        self.size.append(both[first])
        self.places.append(self.at[picked])
        self.whose.append(self.made + new)
        self.made += len(first)
        self.sym[picked], self.len[picked] = self.symbols + new, both
        self.symbols += len(first)
        stay = np.ones(len(self.sym), bool)
        stay[picked + 1] = False
        self.sym, self.len, self.at, self.seg = self.sym[stay], self.len[stay], self.at[stay], self.seg[stay]

    def repair(self) -> bool:
        """A round of Re-Pair; whether a pair occurred twice."""
        inside = np.flatnonzero(self.seg[:-1] == self.seg[1:])
        code = self.sym[inside] * self.symbols + self.sym[inside + 1]
        names, which, times = np.unique(code, return_inverse=True, return_counts=True)
        if not (times > 1).any():
            return False
        shuffled = np.random.default_rng(len(names)).permutation(len(names))
        rank = np.where(times > 1, np.floor(np.log2(times)).astype(np.int64) * len(names) + shuffled, -1)
        score = np.full(len(self.sym) + 1, -1, np.int64)
        score[inside] = rank[which]
        # neighbours of equal score are one pair that overlaps itself: such a row of them wins or loses as a whole
        start = np.flatnonzero(np.diff(score, prepend=-2))
        top = score[start]
        wins = (top >= 0) & (top > np.concatenate(([-1], top[:-1]))) & (top > np.concatenate((top[1:], [-1])))
        row = np.repeat(np.arange(len(start)), np.diff(start, append=len(score)))
        picked = np.flatnonzero(wins[row] & ((np.arange(len(score)) - start[row]) % 2 == 0))
        self.replace(picked, score[picked])
        return True

    def join(self) -> bool:
        """A level of the tree over what Re-Pair left; whether a stretch had several symbols."""
        start = np.flatnonzero(np.diff(self.seg, prepend=-1))
        place = np.arange(len(self.seg)) - np.repeat(start, np.diff(start, append=len(self.seg)))
        picked = np.flatnonzero((place[:-1] % 2 == 0) & (self.seg[:-1] == self.seg[1:]))
        if not len(picked):
            return False
        self.replace(picked, np.arange(len(picked)))
        return True


def matching(ids: np.ndarray, i: int, j: int, most: int, step: int = 1) -> int:
    """How many words from i and from j, read forwards or backwards, are equal; at most ``most``."""
    done, block = 0, 16
    while done < most:
        m = min(block, most - done)
        if step > 0:
            other = np.flatnonzero(ids[i + done : i + done + m] != ids[j + done : j + done + m])
        else:
            other = np.flatnonzero(ids[i - done - m + 1 : i - done + 1][::-1] != ids[j - done - m + 1 : j - done + 1][::-1])
        if len(other):
            return done + int(other[0])
        done += m
        block *= 2
    return most


def crossing(ids: np.ndarray, first: np.ndarray, left: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs that cross a boundary, within the expansion: nonterminal, start and end from its start, period."""
    some = np.flatnonzero(size >= LEAST)
    room = np.maximum(size[some] // POWER, 1)
    n = len(ids) - 1
    part = np.cumsum(room) // CHUNK
    for lo, hi in zip(np.flatnonzero(np.diff(part, prepend=-1)), np.flatnonzero(np.diff(part, append=part[-1] + 1)) + 1 if len(part) else [], strict=True):
        k, m = some[lo:hi], room[lo:hi]
        node = np.repeat(k, m)
        q = np.arange(len(node)) - np.repeat(np.cumsum(m) - m, m) + 1
        b, start = (first + left)[node], first[node]
        end = start + size[node]
        same = lambda i, q: ids[np.clip(i, 0, n)] == ids[np.clip(i + q, 0, n)]
        right = (b + 2 * q <= end) & same(b, q) & same(b + q - 1, q) & same(b + q // 2, q)
        before = (b - 2 * q >= start) & same(b - q - 1, q) & same(b - 2 * q, q) & same(b - q - 1 - q // 2, q)
        last, known = -1, []
        for c in np.flatnonzero(right | before).tolist():
            x, p, at, s, e = int(node[c]), int(q[c]), int(b[c]), int(start[c]), int(end[c])
            if x != last:
                last, known = x, []
            for here, is_square, whole in ((at, right[c], (at, at + 2 * p)), (at - p, before[c], (at - 2 * p, at))):
                if not is_square or any(f <= whole[0] and whole[1] <= g for f, g in known):
                    continue
                back = matching(ids, here - 1, here - 1 + p, here - s, -1)
                f, g = here - back, here + p + matching(ids, here, here + p, e - here - p)
                if f <= whole[0] and whole[1] <= g and g - f >= max(LEAST, POWER * p):
                    known.append((f, g))
                    yield x, f - s, g - s, p


def find_runs(ids: np.ndarray, ends: np.ndarray) -> Runs:
    """All runs of the documents, which are laid end to end in ids."""
    none = (np.empty(0, np.int64),) * 3
    spans = stretches(ids, ends)
    if not spans:
        return none
    g = Grammar(ids, spans)
    if not g.made:
        return none
    found = np.array(list(crossing(ids, np.concatenate(g.first), np.concatenate(g.left), np.concatenate(g.size))), np.int64).reshape(-1, 4)
    if not len(found):
        return none
    whose, places = np.concatenate(g.whose), np.concatenate(g.places)
    order = np.argsort(whose, kind="stable")
    whose, places = whose[order], places[order]
    lo = np.searchsorted(whose, found[:, 0])
    times = np.searchsorted(whose, found[:, 0], "right") - lo
    each = np.repeat(np.arange(len(found)), times)
    at = places[np.repeat(lo, times) + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
    s, e, q = at + found[each, 1], at + found[each, 2], found[each, 3]
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    reach = q * (len(ids) + 1) + e
    whole = reach > np.concatenate(([-1], np.maximum.accumulate(reach)[:-1]))
    s, e, q = s[whole], e[whole], q[whole]
    order = np.lexsort((q, e, s))
    return s[order], e[order], q[order]


def row_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What is said about a document; runs are start, length, period by start, then period."""
    keep = bytearray(b"\1") * len(words)
    for s, n, q in runs:
        keep[s + q : s + n] = bytes(n - q)
    kept = [w for w, k in zip(words, keep, strict=True) if k] if runs else words
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), runs


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs.

    ``edit`` (doc_id and words to words) changes the words first. The greatest run is given by start,
    length and period; the texts are collapsed by dropping each word of a run after its first period.
    ``runs`` lists all of them.

    Null, empty and blank texts have no words: no runs, the four numbers null, digests of nothing.
    Repeated rows are judged each on its own; null doc_ids stay null. A text longer than a slice is a
    slice of its own. An empty table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
    out = pa.schema([
        *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc_ids = part.column("doc_id").to_pylist()
            docs_words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
            if edit:
                docs_words = [edit(i, ws) for i, ws in zip(doc_ids, docs_words, strict=True)]
            number: dict[bytes, int] = defaultdict(count().__next__)
            sizes = [len(ws) for ws in docs_words]
            ids = np.fromiter((number[w] for ws in docs_words for w in ws), np.int64, sum(sizes))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            found: list[list] = [[] for _ in sizes]
            s, e, q = find_runs(ids, ends[np.array(sizes, bool)]) if len(ids) else ([], [], [])
            for d, a, z, p in zip(np.searchsorted(ends, s, "right"), s, e, q, strict=True):
                found[d].append((int(a - starts[d]), int(z - a), int(p)))
            rows = [row_of(ws, runs) for ws, runs in zip(docs_words, found, strict=True)]
            columns = [pa.array([r[i] for r in rows], out.field(i).type) for i in range(7)]
            last = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in row[7]] for row in rows], out.field(7).type)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, last], names=["doc_id", *out.names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
