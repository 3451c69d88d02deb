"""Repeated byte strings against all strings of all texts."""

import hashlib
import random

import numpy as np
import pytest

from annals.llm import suffix_dedup
from annals.llm.suffix_dedup import repeated_strings, samples

SCHEMA = "doc_id long, text string, doc int, tag string, marks int, name string"


def plain(rows):
    """From (doc_id, text), each once: doc_id -> bytes, removed bytes, spans and digest of the rest."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 99):
            s = raw[j : j + 100]
            if s in seen:
                gone[j : j + 100] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeated_strings(docs, **kw).collect()), key=repr)


def texts(seed):
    """Copies, passages in varying surroundings, repeats within a text, periods, strings just below and at the length."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line, long = noise(120), noise(101), noise(3000)
    rows = [noise(rng.randint(0, 400)) for _ in range(10)]
    rows += [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) for _ in range(40)]
    rows += [noise(30) + line[: rng.choice([97, 98, 99, 100, 101])] + noise(30) for _ in range(20)]
    rows += [long, long, long[:1500] + "X" + long[1500:], long[700:], "a" * 500, "ab" * 300, passage + passage + passage, "", "x" * 99, "x" * 100, "x" * 101]
    return list(enumerate(rows))


@pytest.mark.parametrize("wide", [256, 1])
def test_all_repeats_and_no_others(spark, wide):
    rows = [*texts(5), (900, None), (None, "é" * 120)]
    assert result(spark, rows, wide=wide) == sorted(plain(rows).items(), key=repr)


def test_repeats_are_dropped_before_they_are_sent(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SENT", 40)
    rows = texts(8)
    assert result(spark, rows) == sorted(plain(rows).items(), key=repr)


def test_repeated_rows_and_ids(spark):
    a, b = (texts(3)[k][1] for k in (50, 51))
    rows = [(1, a), (1, a), (1, a), (2, a + b), (3, b)]
    want = plain({1: a, 2: a + b, 3: b}.items())
    assert result(spark, rows) == sorted([(r[0], want[r[0]]) for r in rows], key=repr)
    # an id with two texts: the copy is found in one of them
    got = result(spark, [(1, a), (1, a + "!"), (None, "z"), (None, "z")])
    assert sum(r[1][1] for r in got) == len(a.encode()) and len(got) == 4


def test_empty_table(spark):
    assert result(spark, []) == []


def test_equal_strings_have_samples_at_equal_offsets():
    rng = np.random.default_rng(2)
    for trial in range(30):
        s = rng.integers(97, 100 if trial % 2 else 123, 100, dtype=np.uint8)
        found = set()
        for _ in range(3):
            left, right = (rng.integers(97, 123, rng.integers(0, 300), dtype=np.uint8) for _ in range(2))
            x = np.concatenate([left, s, right])
            lo, hi, name, _ = samples(x, np.array([len(x)]))
            k = int(np.flatnonzero((lo <= len(left)) & (len(left) <= hi))[0])
            found.add(int(name[k]))
        assert len(found) == 1


def test_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 5_000_000, dtype=np.uint8).tobytes().decode()
    cut = suffix_dedup.PIECE - 150
    rows = [(1, long), (2, "?" * 50 + long[cut : cut + 400] + "?" * 50), (3, long[:300])]
    got = dict(result(spark, rows))
    assert got[1][1:3] == (0, 0) and got[2][1:3] == (400, 1) and got[3][1:3] == (300, 1)
