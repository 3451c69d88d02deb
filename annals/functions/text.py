"""Text functions: columns to columns, and table functions for sentences, sections and clauses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules


def normalize_surface(s: Column) -> Column:
    """Trimmed, white space collapsed, lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"\s+", " "))


FOLD_FROM, FOLD_TO = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ", "aaaaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnn"


def fold(s: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.translate(s, FOLD_FROM, FOLD_TO))


def slug(s: Column) -> Column:
    """Folded, other characters as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


OPEN, CLOSE = "\x01", "\x02"


def without_templates(s: Column) -> Column:
    """What stands outside of balanced double braces, however deep they are nested; text with other braces stays as it is."""
    marked = F.replace(F.replace(s, F.lit("{{"), F.lit(OPEN)), F.lit("}}"), F.lit(CLOSE))
    pieces = F.split(marked, f"(?={OPEN})|(?<={CLOSE})")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(0).alias("least"))

    def step(at: Column, piece: Column) -> Column:
        opens, closes = F.startswith(piece, F.lit(OPEN)).cast("int"), F.endswith(piece, F.lit(CLOSE)).cast("int")
        depth = at["depth"] + opens
        outside = (depth == 0) & (closes == 0)
        return F.struct((depth - closes).alias("depth"), F.when(outside, F.concat(at["out"], piece)).otherwise(at["out"]).alias("out"), F.least(at["least"], depth - closes).alias("least"))

    end = F.aggregate(pieces, start, step)
    return F.when((end["depth"] == 0) & (end["least"] >= 0), end["out"]).otherwise(s)


def wikitext_to_plain(s: Column, depth: int = 6) -> Column:
    """Comments, references, templates (nested to any depth), links, tags, categories; then white space."""
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?is)<ref[^>/]*/>", "")
    s = F.regexp_replace(s, r"(?is)<ref[^>]*>.*?</ref>", "")
    for _ in range(depth):
        s = F.regexp_replace(s, r"\{\{[^{}]*\}\}", "")
    s = F.when(F.contains(s, F.lit("{{")) & F.contains(s, F.lit("}}")), without_templates(s)).otherwise(s)
    s = F.regexp_replace(s, r"(?i)\[\[(?:file|image|category):[^\[\]]*\]\]", "")
    s = F.regexp_replace(s, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    s = F.regexp_replace(s, r"'{2,}", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_to_plain(s: Column) -> Column:
    """Scripts, styles and comments out, tags to blanks, the common entities decoded, white space collapsed."""
    s = F.regexp_replace(s, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clauses(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per clause, cut at ; and .: the columns of df and clause_index, clause."""
    parts = F.filter(F.transform(F.split(F.col(text), "[;.]"), lambda c: F.trim(c)), lambda c: c != "")
    return df.select("*", F.posexplode(parts).alias("clause_index", "clause"))


def heading_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Pieces between wiki headings: the columns of df and chunk_index, chunk."""
    parts = F.transform(F.split(F.col(text), "={2,}[^=]+={2,}"), lambda c: F.trim(c))
    return df.select("*", F.posexplode(parts).alias("chunk_index", "chunk")).filter("chunk <> ''")


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ordinal, title, body: lines gathered below the heading before them; those before any heading are Lead."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    title = F.regexp_extract("line", r"^={2,}\s*([^=]+?)\s*={2,}\s*$", 1)
    lines = lines.withColumn("title", F.when(title != "", title))
    running = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("ordinal", F.count("title").over(running))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("title").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy(key, "ordinal").agg(F.coalesce(F.max("title"), F.lit("Lead")).alias("title"), F.trim(body).alias("body"))
    return out.filter("ordinal > 0 or body <> ''")


#: Not in any text: Unicode sets them aside. The first that a text lacks marks its boundaries.
MARKS = ["\ufdd0", "\ufdd1", "\ufdd2"]
#: What follows . ! or ? and blanks for a sentence to end there: a capital or digit, or a quote or bracket before one.
START = r"""(?=[A-Z0-9]|["'(][A-Z0-9])"""
HEADING = "={2,}[^=]+={2,}"


def boundary_pattern() -> str:
    """. ! or ? with the blanks after it where a sentence ends: not after an abbreviation, a single initial or a number of one to three digits."""
    abbreviations = "|".join(re.escape(a) for a in rules.ABBREVIATIONS)
    return rf"[.!?](?<!{abbreviations})(?<![ \n][A-Z].)(?<!(?<![0-9])[0-9]{{1,3}}.)[ \t\n\r\f]*{START}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def prefix_sums(sizes: Column, block: int = 64) -> Column:
    """For each element the sum of those before it. Blocks first, so that the arrays that are copied stay short."""

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, start, step)["out"]

    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(block))
    parts = F.transform(starts, lambda i: F.slice(sizes, i, F.lit(block)))
    bases = lambda ps: running(F.transform(ps, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)))
    return let(parts, lambda ps: F.flatten(F.zip_with(ps, bases(ps), lambda p, b: F.transform(running(p), lambda x: x + b))))


def sentence_spans(text: Column) -> Column:
    """array<struct<sentence, char_start, char_end>>: the sentences of a text, with offsets in bytes of the trimmed text.

    A sentence goes from a boundary, without the spaces after it, to the next: ends of sentences and both ends of wiki
    headings. It has at least 12 bytes and a letter; what starts with == is none. Null gives an empty array.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")

    def cut(s: Column) -> Column:
        mark = F.lit(MARKS[-1])
        for m in MARKS[-2::-1]:
            mark = F.when(F.contains(s, F.lit(m)), mark).otherwise(F.lit(m))
        headed = lambda m: F.when(F.contains(s, F.lit("==")), F.regexp_replace(s, F.lit(f"({HEADING})"), F.concat(m, F.lit("$1"), m))).otherwise(s)
        return let(mark, lambda m: F.filter(F.split(F.regexp_replace(headed(m), F.lit(f"({boundary_pattern()})"), F.concat(F.lit("$1"), m)), m), lambda p: p != ""))

    def span(p: Column, at: Column) -> Column:
        return F.struct(
            F.regexp_replace(p, r"(?U)^\s+|\s+$", "").alias("sentence"),
            (at + F.octet_length(p) - F.octet_length(F.ltrim(p))).cast("int").alias("char_start"), (at + F.octet_length(p)).cast("int").alias("char_end"),
        )

    whole = lambda x: (F.octet_length(x["sentence"]) >= 12) & x["sentence"].rlike(r"\p{IsAlphabetic}") & ~F.startswith(x["sentence"], F.lit("=="))
    ends = lambda ps: prefix_sums(F.transform(ps, lambda p: F.octet_length(p).cast("long")))
    return let(let(trimmed, cut), lambda ps: let(ends(ps), lambda at: F.filter(F.zip_with(ps, at, span), whole)))


def sentences(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, ordinal, sentence, char_start, char_end: a row for each sentence."""
    rows = df.select(*keys, F.posexplode(sentence_spans(F.col(text))).alias("ordinal", "_s"))
    return rows.select(*keys, "ordinal", *[F.col("_s")[c].alias(c) for c in ("sentence", "char_start", "char_end")])
