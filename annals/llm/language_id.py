"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of the characters in its words, with marks at both ends of a word. For
every order the n-grams of all languages stand in one sorted array of hashes, beside a row of
discounted probabilities by language; contexts likewise with their back-off weights. A text's
cross-entropy under a language is the sum over its words divided by the number of characters;
the lowest wins. Words repeat, so a worker keeps the scores of those it has met.

The limits beyond which a text is rejected are calibrated on documents that the counts don't include,
by language and number of letters: ``slack`` times the 99.5 % quantile of the cross-entropies of their
windows of about that size. Documents beyond ``slack`` times the usual median of their size are taken for junk or
mislabelled and don't count. Fewer letters never have a narrower limit, and none is without one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 500_000
UNKNOWN = "und"
MOST_LANGUAGES = 10_000  # up to so many, their counts are broadcast
DISCOUNT = 0.75  # the usual absolute discount
ALPHABET = 1 << 16  # an unseen character has one part in so many
QUANTILE = 0.995
SIZES = 24  # windows and limits for 1, 2, 4, ... letters
WINDOWS = 8  # of each size from a document
PRIME = np.uint64(0x100000001B3)


def letters(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k up to order: the hash of the k characters that end at each place of each word; and each place's word.

    A place is a character of the word or its end; before a word stand marks.
    """
    marked = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + order for w in words], np.int64)
    within = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.flatnonzero(within >= order - 1)
    x = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    out, h = [], np.zeros(len(place), np.uint64)
    for k in range(order):
        h = (h ^ x[place - k]) * PRIME
        h ^= h >> np.uint64(32)
        out.append(h)
    return out, np.repeat(np.arange(len(words)), sizes)[place]


def contexts(words: list[str], order: int) -> list[np.ndarray]:
    """For each k from 2 to order: the hash of the k - 1 characters before each place."""
    marked = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + order for w in words], np.int64)
    within = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.flatnonzero(within >= order - 1)
    x = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    out, h = [], np.zeros(len(place), np.uint64)
    for k in range(1, order):
        h = (h ^ x[place - k]) * PRIME
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def fit_language(words: dict[str, int], order: int) -> list[tuple[np.ndarray, ...]]:
    """For each order: n-gram hashes, their discounted probabilities, context hashes, their back-off weights.

    The highest order counts occurrences; lower ones count the distinct characters before an n-gram.
    """
    names = list(words)
    weight = np.array([words[w] for w in names], np.int64)
    hashes, owner = grams(names, order)
    before = [np.zeros(len(owner), np.uint64), *contexts(names, order)]
    times = weight[owner]
    out = []
    for k in range(order):
        if k == order - 1:
            keys, first, inverse = np.unique(hashes[k], return_index=True, return_inverse=True)
            count = np.bincount(inverse, times).astype(np.float64)
        else:  # continuation counts: distinct longer n-grams that end in it
            _, longer = np.unique(hashes[k + 1], return_index=True)
            keys, inverse = np.unique(hashes[k][longer], return_inverse=True)
            first = longer[np.unique(inverse, return_index=True)[1]]
            count = np.bincount(inverse).astype(np.float64)
        context, of = np.unique(before[k][first], return_inverse=True)
        total = np.bincount(of, count)
        kinds = np.bincount(of)
        prob = (count - DISCOUNT) / total[of]
        out.append((keys, prob.astype(np.float32), context, (DISCOUNT * kinds / total).astype(np.float32)))
    return out


@dataclass
class Models:
    """All languages' models side by side."""

    langs: list[str]
    order: int
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    limits: np.ndarray | None = None  # by language and the power of two of the number of letters

    def limit(self, langs: np.ndarray, n_letters: np.ndarray) -> np.ndarray:
        return np.full(len(langs), np.inf) if self.limits is None else self.limits[langs, sizes_of(n_letters)]

    @classmethod
    def join(cls, langs: list[str], fits: list[list[tuple[np.ndarray, ...]]], order: int) -> Models:
        tables = []
        for k in range(order):
            row = []
            for keys, values, none in ((0, 1, 0.0), (2, 3, 1.0)):
                union = np.unique(np.concatenate([f[k][keys] for f in fits]))
                grid = np.full((len(union), len(langs)), none, np.float32)
                for j, f in enumerate(fits):
                    grid[np.searchsorted(union, f[k][keys]), j] = f[k][values]
                row += [union, grid]
            tables.append(tuple(row))
        return cls(langs, order, tables)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Nats of each word under each language."""
        hashes, owner = grams(words, self.order)
        before = [np.zeros(len(owner), np.uint64), *contexts(words, self.order)]
        p = np.full((len(owner), len(self.langs)), 1 / ALPHABET, np.float32)
        for k, (keys, probs, context, back) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(keys, hashes[k]), len(keys) - 1)
            own = np.where((keys[at] == hashes[k])[:, None], probs[at], np.float32(0))
            at = np.minimum(np.searchsorted(context, before[k]), len(context) - 1)
            p = own + np.where((context[at] == before[k])[:, None], back[at], np.float32(1)) * p
        nats = -np.log(p)
        return np.stack([np.bincount(owner, nats[:, j], minlength=len(words)) for j in range(len(self.langs))], axis=1)


class Scorer:
    """Cross-entropies of texts; keeps the scores of words."""

    def __init__(self, models: Models):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((1 << 14, len(self.models.langs)))

    def learn(self, new: list[str]) -> None:
        at = len(self.known)
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        for i in range(0, len(new), 20_000):
            self.scores[at + i : at + i + len(new[i : i + 20_000])] = self.models.score_words(new[i : i + 20_000])
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character by text and language, and the number of letters."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        out, n_letters = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = letters(text)
            if not words:
                continue
            codes = list(map(self.known.get, words))
            if None in codes:
                self.learn(list({w for w, c in zip(words, codes, strict=True) if c is None}))
                codes = list(map(self.known.get, words))
            n_letters[i] = sum(map(len, words))
            out[i] = self.scores[codes].sum(axis=0) / (n_letters[i] + len(words))
        return out, n_letters


def trainer(order: int, share: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Models of one language from its sampled documents; one of every ``share`` is left for calibration."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        words: dict[str, int] = {}
        for text in docs["text"][docs["_n"] % share != 0 if len(docs) > 1 else docs["_n"] > 0]:
            for w in letters(text):
                words[w] = words.get(w, 0) + 1
        fits = fit_language(words, order) if words else []
        rows = [(docs["lang"].iloc[0], k, *[x.tobytes() for x in f]) for k, f in enumerate(fits)]
        return pd.DataFrame(rows, columns=["lang", "k", "keys", "probs", "contexts", "back"])

    return run


def sample_rows(docs: DataFrame, per_lang: int) -> DataFrame:
    """Up to per_lang documents of each language, those whose ids have the smallest hashes.

    Rows are first thinned by hash to about four times as many as are wanted of each language, so
    that what meets in a language's task is as small for any table.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("_of")), "languages")
    if counts.count() <= MOST_LANGUAGES:
        counts = F.broadcast(counts)
    place = F.xxhash64("doc_id", "text")
    share = F.pmod(F.shiftright(place, 11), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.join(counts, "lang").filter(share * F.col("_of") < 4 * per_lang).drop("_of")
    order = Window.partitionBy("lang").orderBy(share, place, "doc_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_lang)


def fit(docs: DataFrame, per_lang: int = 400, order: int = 4, slack: float = 1.4) -> Models:
    """Models from the text and lang of docs.

    Bound of the sample: ``per_lang`` whole documents of each language. The models that reach the
    driver are bounded by it too. Rows with null text or lang aren't used; without any, there are no languages.
    """
    rows = sample_rows(docs, per_lang)
    got = rows.groupBy("lang").applyInPandas(trainer(order, 5), "lang string, k int, keys binary, probs binary, contexts binary, back binary").collect()
    fits: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.k)):
        fits.setdefault(r.lang, []).append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r.probs, np.float32), np.frombuffer(r.contexts, np.uint64), np.frombuffer(r.back, np.float32)))
    langs = sorted(fits)
    if not langs:
        return Models([], order, [])
    models = Models.join(langs, [fits[x] for x in langs], order)
    held = docs.sparkSession.sparkContext.broadcast(models)
    left = rows.filter("_n % 5 = 0").groupBy("lang").applyInPandas(calibrator(held, slack), "lang string, limits array<double>").collect()
    models.limits = all_limits(langs, {r.lang: np.array(r.limits, np.float64) for r in left})
    return models


def sizes_of(n_letters: np.ndarray) -> np.ndarray:
    """The power of two of each number of letters, at most SIZES - 1."""
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64), SIZES - 1)


def windows(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of runs of words with 1, 2, 4, ... letters at least, up to WINDOWS of each, and all words."""
    ends = np.cumsum(lengths)
    starts = np.unique(np.arange(WINDOWS) * len(lengths) // WINDOWS)
    out = [(0, len(lengths))]
    for size in range(SIZES):
        to = np.searchsorted(ends, ends[starts] - lengths[starts] + (1 << size)) + 1
        out += [(int(a), int(b)) for a, b in zip(starts, to, strict=True) if b <= len(lengths)]
    return out


def limits_of(documents: list[list[tuple[int, float]]], slack: float) -> np.ndarray:
    """Limits by size; NaN for sizes beyond any window. documents: (letters, cross-entropy) of the windows of each, the whole text first."""
    flat = [w for d in documents for w in d]
    if not flat:
        return np.full(SIZES, np.nan)
    of, own = sizes_of(np.array([n for n, _ in flat])), np.array([e for _, e in flat])
    by = np.repeat(np.arange(len(documents)), list(map(len, documents)))
    common = [k for k in np.unique(of) if 2 * len(np.unique(by[of == k])) >= len(documents)] or [np.bincount(of).argmax()]
    usual = [np.median(own[of == k]) for k in common]  # of sizes that most documents have; longer ones take the last
    fits = [d for d in documents if d[0][1] <= slack * usual[max(np.searchsorted(common, sizes_of(np.array([d[0][0]]))[0], "right") - 1, 0)]]
    flat = [w for d in fits or documents for w in d]
    of, own = sizes_of(np.array([n for n, _ in flat])), np.array([e for _, e in flat])
    out = np.full(SIZES, np.nan)
    for k in np.unique(of):
        out[k] = slack * np.quantile(own[of == k], QUANTILE)
    return out


def all_limits(langs: list[str], found: dict[str, np.ndarray]) -> np.ndarray | None:
    """A row for each language. Sizes that a language lacks take its nearest longer one, then its nearest shorter one;
    languages without calibration documents take the widest of the others; None if no language has any."""
    grid = np.stack([found.get(x, np.full(SIZES, np.nan)) for x in langs])
    if np.isnan(grid).all():
        return None
    for k in range(SIZES - 2, -1, -1):  # never narrower for fewer letters
        grid[:, k] = np.fmax(grid[:, k], grid[:, k + 1])
    for k in range(1, SIZES):
        grid[:, k] = np.where(np.isnan(grid[:, k]), grid[:, k - 1], grid[:, k])
    return np.where(np.isnan(grid), np.nanmax(grid, axis=0), grid)


def calibrator(held, slack: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        scorer, lang = Scorer(held.value), docs["lang"].iloc[0]
        documents = []
        if lang in held.value.langs:
            j = held.value.langs.index(lang)
            for text in docs["text"]:
                words = letters(text)
                if not words:
                    continue
                scorer.entropies([text])
                lengths, nats = np.array(list(map(len, words))), scorer.scores[[scorer.known[w] for w in words], j]
                documents.append([(int(lengths[a:b].sum()), float(nats[a:b].sum() / (lengths[a:b].sum() + b - a))) for a, b in windows(lengths)])
        return pd.DataFrame({"lang": [lang], "limits": [limits_of(documents, slack)]})

    return run


_SCORERS: dict[str, Scorer] = {}


def predictor(key: str, held, extra: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(held.value)
        scorer = _SCORERS[key]
        models = scorer.models
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            n_letters, best = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            limit = np.full(len(texts), np.inf)
            langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if models.langs:
                entropy, n_letters = scorer.entropies(texts)
                win = entropy.argmin(axis=1)
                best = entropy[np.arange(len(texts)), win]
                limit = models.limit(win, n_letters)
                near = np.exp(-8 * (entropy - best[:, None]))
                score = np.where(n_letters > 0, 1 / near.sum(axis=1), 0.0)
                langs = [models.langs[w] if n else UNKNOWN for w, n in zip(win.tolist(), n_letters.tolist(), strict=True)]
            rejected = (n_letters == 0) | (best > limit)
            cols = {c: batch.column(c) for c in extra}
            cols |= {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "entropy": pa.array(best, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for every document, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the
    language that sorts first; whole texts are read, whatever their length; with no languages all
    are ``und`` and those with text of letters count as rejected too.
    """
    return _map(docs.select("doc_id", F.col("text").cast("string").alias("text")), models, ["doc_id"])


def _map(rows: DataFrame, models: Models, extra: list[str]) -> DataFrame:
    import uuid

    held = rows.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*extra).schema.fields)
    run = predictor(uuid.uuid4().hex, held, extra)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def training_part(docs: DataFrame) -> DataFrame:
    """The documents that a model may learn from: crc32 of the id as text, modulo 4, isn't 2."""
    return docs.filter(F.coalesce(fold(), F.lit(0)) != 2)


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document; learned from training_part."""
    models = fit(training_part(docs))
    held_out = F.coalesce(fold() == 2, F.lit(False))
    return identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    names = {c: f"_d_{c}" for c in docs.columns}
    rows = docs.withColumnsRenamed(names).withColumn("text", F.col("_d_text").cast("string"))
    out = _map(rows, models, list(names.values()))
    return out.filter("not rejected").select(*[F.col(v).alias(k) for k, v in names.items()])
