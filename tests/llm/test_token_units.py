import sys

import regex
from test_token_counts import greedy
from tokenizers import Tokenizer

from annals.llm.queries import op8_token_counts
from annals.llm.token_counts import END, default_path, solid_parts, token_counts, units, vocabulary

TEXTS = [None, "", "?!", "Don't! it's 'start' 1805 x2 a_b", "É Éa ΑΣ İx \u0041\u030a", "?\x1c! a\x1fb\u3000c\x85d", "²½Ⅷ 漢字 \U0001f600\U0001f600", "|--|==| {a: [1, 22]};", "the " * 3000]


def by_file(tok, text):
    return [u for u, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text or ""))]


def written(us):
    from annals.llm.tokens import byte_letters

    letter = byte_letters()
    return ["".join(chr(letter[b]) for b in u) for u in us]


def test_units_are_the_files_own(spark):
    tok = Tokenizer.from_file(default_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [*TEXTS, *[d.text for d in docs]]:
        assert written(units(text)) == by_file(tok, text)


def test_white_space_is_the_rules():
    for c in map(chr, range(sys.maxunicode + 1)):
        if not "\ud800" <= c <= "\udfff" and (c.isspace() or regex.match(r"\s", c)):
            assert len(solid_parts(f"a{c}b")) == (2 if regex.match(r"\s", c) else 1)


def test_whole_texts_are_counted(spark):
    known = {*vocabulary(default_path()), (END,)}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, whole=True).collect()}
    assert got == {i: sum(greedy(known, u) for u in units(t)) for i, t in enumerate(TEXTS)}
    assert got[2] > 0


def test_query_counts_punctuation(spark, tmp_path):
    spark.createDataFrame([(1, "?!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_token_counts(spark, str(tmp_path)).first().n_tokens > 0
