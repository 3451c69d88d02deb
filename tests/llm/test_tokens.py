import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annals.llm.tokens import Encoder, default_path, pack, read_ids, unpack, write_ids


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(0)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, offsets = pack(values)
    assert unpack(words, offsets).tolist() == values.tolist()
    if len(offsets) > 1:  # a sub-block decodes by itself
        assert unpack(words[offsets[1] :], None).tolist() == values[1024:].tolist()


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_path())


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n.,'sthe!?1é\t\xa0\x1c²ɐ語"), st.characters(codec="utf-8")), max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(enc, texts):
    ids, lengths = enc.encode(texts)
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_files_read_back(spark, enc):
    rows = [(5, "the end."), (3, None), (9, ""), (1, "a  b\n\nc " * 500), (9, "again"), (None, "no id"), (2**40, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, part int").repartition(3)
    path = tempfile.mkdtemp() + "/ids"
    write_ids(docs, path)
    got = read_ids(spark, path).orderBy("start").collect()
    start, left = 0, defaultdict(list)
    for i, t in rows:
        left[i].append(np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    for r in got:
        left[r.doc_id].remove(bytes(r.ids))
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in read_ids(spark, path, digest=True).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}


def test_empty_table(spark):
    path = tempfile.mkdtemp() + "/ids"
    write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_ids(spark, path).count() == 0
