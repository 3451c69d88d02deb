"""Sentences and their offsets, against a reading byte by byte."""

import random

from annals import rules
from annals.functions.text import sentences

BLANKS = b" \t\n\r\x0c"
UPPER_DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def starts(b, i):
    return i < len(b) and (b[i] in UPPER_DIGIT or b[i] in b"\"'(" and i + 1 < len(b) and b[i + 1] in UPPER_DIGIT)


def short(b, i):
    head = b[: i + 1]
    if any(head.endswith(a.encode()) for a in rules.ABBREVIATIONS):
        return True
    if i >= 2 and chr(b[i - 1]) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and b[i - 2] in b" \n":
        return True
    n = 0
    while n < i and b[i - 1 - n] in b"0123456789":
        n += 1
    return 0 < n < 4


def plain(text):
    b = (text or "").strip().encode()
    cuts = set()
    for i, c in enumerate(b):
        if c in b".!?" and not short(b, i):
            j = i + 1
            while j < len(b) and b[j] in BLANKS:
                j += 1
            if starts(b, j):
                cuts.add(j)
    i = 0
    while i + 4 < len(b):
        j = i
        while j < len(b) and b[j] == ord("="):
            j += 1
        k = j
        while k < len(b) and b[k] != ord("="):
            k += 1
        end = k
        while end < len(b) and b[end] == ord("="):
            end += 1
        if j - i >= 2 and end - k >= 2 and k > j:
            cuts |= {i, end}
            i = end
        else:
            i += 1
    out, start = [], 0
    for end in [*sorted(cuts), len(b)]:
        s = b[start:end].decode().strip()
        if len(s.encode()) >= 12 and any(c.isalpha() for c in s) and not s.startswith("=="):
            out.append((len(out), s, start, end))
        start = end
        while start < len(b) and b[start] == ord(" "):
            start += 1
    return out


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sentences(df, "k").collect():
        out[r.k].append((r.ordinal, r.sentence, r.char_start, r.char_end))
    return [sorted(v) for v in out.values()]


def test_by_hand(spark):
    text = "  Mr. Smith met J. Bach in 1805. He left. It was one of them! (He said so.) nothing"
    assert rows(spark, [text])[0] == [
        (0, "Mr. Smith met J. Bach in 1805.", 0, 31),
        (1, "It was one of them!", 40, 60),
        (2, "(He said so.) nothing", 60, 81),
    ]
    headed = "== Early life. And More of it ==Élise was born there.  \"Go!\" \n She said 12. Then 1812. Then no more"
    assert rows(spark, [headed, None, ""]) == [plain(headed), [], []] and [s for _, s, _, _ in plain(headed)][:2] == ["And More of it ==", "Élise was born there."]


def test_any_text(spark):
    rng = random.Random(6)
    bits = ["Ann", "bob went", ". ", "! ", "?", ".", " ", "\n", "\t", "==", "===", "=", "Dr.", "e.g.", " B. ", "12", "1805", "345.", "7", "(", '"', "é", "Été", "etc.", " ", "﷐", "word and word "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert rows(spark, texts) == [plain(t) for t in texts]


def test_long_text(spark):
    text = "Some words came here. " * 30_000
    got = rows(spark, [text])[0]
    assert len(got) == 30_000 and got[-1] == (29_999, "Some words came here.", 22 * 29_999, 22 * 30_000 - 1)
