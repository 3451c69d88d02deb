import random

from hypothesis import given, settings
from hypothesis import strategies as st

from annals.llm.common import alnum_words
from annals.llm.token_counts import END, Automaton, default_path, token_counts, vocabulary


def greedy(pieces, word):
    symbols, at, n = (*word, END), 0, 0
    while at < len(symbols):
        size = max((k for k in range(1, len(symbols) - at + 1) if symbols[at : at + k] in pieces), default=0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


PIECE = st.tuples(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=5), st.booleans()).map(lambda x: (*x[0], *([END] if x[1] else [])))


@given(st.lists(PIECE, max_size=25), st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(b"abcd"[x % 4] for x in b)), max_size=10))
@settings(max_examples=300, deadline=None)
def test_automaton_matches_greedy(pieces, words):
    a, known = Automaton(pieces), {*pieces, (END,)}
    for w in words:
        assert a.count(w) == greedy(known, w)


def test_table(spark):
    pieces = vocabulary(default_path())
    known = {*pieces, (END,)}
    rnd = random.Random(4)
    rows = [(i, " ".join("".join(rnd.choice("etaoinshé1") for _ in range(rnd.randrange(1, 12))) for _ in range(30))) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "?!"), (33, "the " * 30000), (0, rows[0][1]), (None, "Naïve"), (34, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in token_counts(docs).collect()), key=repr)
    want = [(i, len(alnum_words(t)), sum(greedy(known, w) for w in alnum_words(t))) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(docs.limit(0)).count() == 0
