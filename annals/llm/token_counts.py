"""Token counts: a linear longest-match automaton over a vocabulary trie.

Greedy word-piece lengths need no pieces: each trie node has a failure link, the node of what is
left once the pieces that longest match certainly takes are popped, and the number of those pieces.
A word then takes one step a symbol, plus one for each pop. Symbols are the UTF-8 bytes of a word
and a mark at its end; pieces of the vocabulary that end words carry the mark. The mark alone is a
piece too, so that a vocabulary with all single bytes never fails; with others, a word that cannot
be cut is one unknown piece.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, slices
from .tokens import byte_letters

END = 256
CACHE_WORDS = 500_000
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNIT = regex.compile(RULE)
SOLID = regex.compile(r"\S+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # blanks to str.split, but not to the rule


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level BPE file with word ends, as symbols."""
    letters = {chr(v): k for k, v in byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, out = model["end_of_word_suffix"], []
    for piece in model["vocab"]:
        body, end = (piece[: -len(mark)], (END,)) if mark and piece.endswith(mark) else (piece, ())
        if body and all(c in letters for c in body):
            out.append((*[letters[c] for c in body], *end))
    return out


def check_rule(path: str) -> None:
    """Raises ValueError unless the file normalizes and pre-tokenizes as solid_parts and UNIT do."""
    with open(path, encoding="utf-8") as f:
        rule = json.load(f)
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": RULE}, "behavior": "Removed", "invert": True}
    letters = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    first, last = rule["normalizer"]["normalizers"], rule["pre_tokenizer"]["pretokenizers"]
    if first != [{"type": "NFC"}, blanks, {"type": "Lowercase"}] or [{k: v for k, v in x.items() if k != "trim_offsets"} for x in last] != [split, letters]:
        raise ValueError(f"another normalizer or pre-tokenizer than that of word_bpe_49k.json: {path}")


def solid_parts(text: str | None) -> list[str]:
    """The normalized text's runs without white space. Lower case is taken character by character: no final sigma."""
    low = unicodedata.normalize("NFC", text or "").replace("Σ", "σ").lower()
    return SOLID.findall(low) if SEPARATORS.search(low) else low.split()


def units(text: str | None) -> list[bytes]:
    """The tokenizer file's pre-tokens: contractions, words, single digits, runs of other characters; in UTF-8."""
    return [u.encode("utf-8", "surrogatepass") for part in solid_parts(text) for u in UNIT.findall(part)]


class Automaton:
    """go: node and symbol to node; fail and pops: by node; fail is -1 where nothing can be popped."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.go: dict[int, int] = {}
        ends, parents, symbols = [False], [0], [0]
        for piece in [*pieces, (END,)]:
            u = 0
            for c in piece:
                v = self.go.get(u << 9 | c)
                if v is None:
                    v = self.go[u << 9 | c] = len(ends)
                    ends.append(False)
                    parents.append(u)
                    symbols.append(c)
                u = v
            ends[u] = True
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for v in range(1, len(ends)):
            depth[v] = depth[parents[v]] + 1  # parents come first
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, n = self.fail[parents[v]], self.pops[parents[v]]
            while z >= 0 and (z << 9 | symbols[v]) not in self.go:
                z, n = self.fail[z], n + self.pops[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.go[z << 9 | symbols[v]], n

    def count(self, word: bytes) -> int:
        """Number of greedy pieces; 1 if the word can't be cut."""
        u = n = 0
        go, fail, pops = self.go, self.fail, self.pops
        for c in (*word, END):
            while (v := go.get(u << 9 | c)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class Counts(dict):
    """Counts of the words that a worker has met."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = self.automaton.count(word)
        if len(word) < 100:
            self[word] = n
        return n


class PartCounts(dict):
    """Counts of the runs without white space that a worker has met, by their units: none crosses white space."""

    def __init__(self, words: Counts):
        super().__init__()
        self.words = words

    def __missing__(self, part: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = sum(self.words[u.encode("utf-8", "surrogatepass")] for u in UNIT.findall(part))
        if len(part) < 100:
            self[part] = n
        return n


_COUNTS: dict[str, tuple[Counts, PartCounts]] = {}


def counter(path: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTS:
            words = Counts(Automaton(vocabulary(path)))
            _COUNTS[path] = words, PartCounts(words)
        of_word, of_part = (c.__getitem__ for c in _COUNTS[path])
        for batch in slices(batches):
            plain = batch.column("text").to_pylist()
            texts = [alnum_words(t) for t in plain]
            n_tokens = [sum(map(of_part, solid_parts(t))) for t in plain] if whole else [sum(map(of_word, ws)) for ws in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(ws) for ws in texts], pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens for every document, a map over the rows as they are read.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. n_tokens counts the pieces
    of the whole text, cut by the tokenizer file's rule into units, or without ``whole`` those of the
    words alone. Names of added tokens are cut like other text. Null and empty texts
    have none; very long texts and words are read whole; repeated rows are counted each; an empty
    table gives no rows. Other columns are not looked at.
    """
    path = tokenizer or default_path()
    if whole:
        check_rule(path)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counter(path, whole), f"doc_id {kind}, n_words long, n_tokens long")
