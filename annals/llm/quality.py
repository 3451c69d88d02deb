"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is half of the
squared sums less the sums of squares, so a document takes time linear in its features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, slices

WORD_BITS = 14
N_WORDS = 1 << WORD_BITS
RANK = 8
STATS = (
    "length", "n_words", "word_length", "upper", "digits", "marks", "symbols", "beyond_ascii", "blanks", "lines", "repeated_lines",
    "distinct_words", "distinct_pairs", "same_as_before", "commonest_word", "stated_length",
)
DIM = N_WORDS + len(STATS)
#: Classes of bytes: 1 A-Z, 2 digits, 3 common marks, 4 other ASCII symbols, 5 beyond ASCII, 6 white space, 0 the rest.
CLASS = np.array([5 if b >= 128 else 6 if b in b" \t\n\r" else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b".,;:'\"-()?" else 0 if 97 <= b <= 122 else 4 for b in range(256)], np.uint8)


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) & (N_WORDS - 1)
        return h


_BUCKETS = Buckets()


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: hashed words with unit length, then STATS in their raw form."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = alnum_words(text)
    codes = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    places, counts = np.unique(codes, return_counts=True)
    values = np.log1p(counts)
    values /= max(1e-9, np.sqrt((values**2).sum()))
    kinds = np.bincount(CLASS[np.frombuffer(data, np.uint8)], minlength=7) / max(1, len(data))
    lines = (text or "").split("\n")
    n = max(1, len(words))
    stats = [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        len(lines) / n, 1 - len(set(lines)) / len(lines), len(set(words)) / n,
        len(np.unique(codes[1:] * N_WORDS + codes[:-1])) / n if len(codes) > 1 else 1.0, float((codes[1:] == codes[:-1]).sum()) / n,
        counts.max() / n if len(counts) else 0.0, np.log1p(max(0, n_chars)) if n_chars is not None else np.log1p(len(text or "")),
    ]
    return np.concatenate([places, N_WORDS + np.arange(len(STATS))]), np.concatenate([values, stats])


@dataclass
class Machine:
    """Weights, and the means and deviations that the statistics are scaled by."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def blank(cls) -> Machine:
        return cls(0.0, np.zeros(DIM), np.random.default_rng(7).normal(0, 0.05, (DIM, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))

    def scale(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        own = places >= N_WORDS
        k = places[own] - N_WORDS
        out[own] = 0.3 * np.clip((values[own] - self.mean[k]) / self.std[k], -4, 4)
        return out

    def margins(self, places: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By document: the margin, and the sums that its gradient needs. begin: where each document's features start."""
        vx = self.v[places] * x[:, None]
        total = np.add.reduceat(vx, begin)
        squares = np.add.reduceat((vx**2).sum(axis=1), begin)
        return self.w0 + np.add.reduceat(self.w[places] * x, begin) + 0.5 * ((total**2).sum(axis=1) - squares), total

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        """AdaGrad on the logistic loss, in batches."""
        stats = np.array([v[-len(STATS) :] for _, v in docs])
        self.mean, self.std = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        docs = [(p, self.scale(p, v)) for p, v in docs]
        rng, gw, gv, g0 = np.random.default_rng(11), np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), 32):
                of = order[i : i + 32]
                sizes = np.array([len(docs[j][0]) for j in of])
                places, x = np.concatenate([docs[j][0] for j in of]), np.concatenate([docs[j][1] for j in of])
                margin, total = self.margins(places, x, np.cumsum(sizes) - sizes)
                err = (1 / (1 + np.exp(-margin)) - y[of]) / len(of)
                e, t = np.repeat(err, sizes), np.repeat(total, sizes, axis=0)
                seen, back = np.unique(places, return_inverse=True)
                dw = np.bincount(back, e * x) + decay * self.w[seen]
                dv = np.zeros((len(seen), RANK))
                np.add.at(dv, back, (e * x)[:, None] * (t - self.v[places] * x[:, None]))
                dv += decay * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                g0 += err.sum() ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= 0.5 * rate * dv / np.sqrt(gv[seen])
                self.w0 -= rate * err.sum() / np.sqrt(g0)
        return self

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Between 0 and 1 for every document."""
        sizes = np.array([len(p) for p, _ in docs])
        places, x = np.concatenate([p for p, _ in docs]), np.concatenate([self.scale(p, v) for p, v in docs])
        margin, _ = self.margins(places, x, np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"), *more)


def featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "places": pa.array([p for p, _ in found], pa.list_(pa.int64())), "values": pa.array([v for _, v in found], pa.list_(pa.float64()))}
        )


def trainer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts).sort_values(["doc_id", "y"], kind="stable")
    m = Machine.blank().fit(list(zip(rows["places"], rows["values"], strict=True)), rows["y"].to_numpy(np.float64))
    yield pd.DataFrame({"w0": [m.w0], "w": [m.w.tobytes()], "v": [m.v.tobytes()], "mean": [m.mean.tobytes()], "std": [m.std.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> Machine:
    """A machine learned from the labelled documents.

    Bound: the ``sample`` labelled ids with the smallest hashes, whole texts; of rows that repeat an id, the one
    whose text has the least hash. Rows with null labels or ids aren't used; an id with both labels counts
    as 1. Without labelled documents all scores are near 0.5.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    one = F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars"))  # combined before rows meet
    rows = rows.groupBy("doc_id", "y").agg(one.alias("row")).select("doc_id", "row.text", "row.n_chars", "y")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(featurizer, f"doc_id {kind}, y int, places array<long>, values array<double>")
    row = found.repartition(1).mapInPandas(trainer, "w0 double, w binary, v binary, mean binary, std binary").first()  # one task, bounded by the sample
    if row is None:
        return Machine.blank()
    array = lambda b: np.frombuffer(b, np.float64)
    return Machine(row.w0, array(row.w), array(row.v).reshape(DIM, RANK), array(row["mean"]), array(row["std"]))


_MACHINES: dict[str, Machine] = {}


def scorer(key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MACHINES:
            _MACHINES.clear()
            _MACHINES[key] = held.value
        for batch in slices(batches):
            found = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_MACHINES[key].scores(found), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score for every document, from its text and n_chars alone, a map over the rows as they are read.

    Null and empty texts are scored by their (empty) statistics; a null n_chars is the text's own
    length; very long texts are read whole; repeated rows are scored each; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(scorer(uuid.uuid4().hex, held), f"doc_id {kind}, score double")


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of held-out ids (fold 1) aren't looked at."""
    machine = fit(docs, labels.filter(F.coalesce(fold(), F.lit(0)) != 1), "quality")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return score(docs, machine).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))
