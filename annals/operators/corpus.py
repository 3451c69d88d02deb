"""Joins, merges and reports over corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals.functions.text import fold
from annals.session import written


def keyset_page(rows: DataFrame, score: str, key: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``size`` rows by score and key, both descending, after the cursor (score, key)."""
    if cursor is not None:
        s, k = cursor
        rows = rows.filter((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) < k)))
    return rows.orderBy(F.desc(score), F.desc(key)).limit(size)


def counts_with_zero(left: DataFrame, right: DataFrame, on: str, counted: str, name: str) -> DataFrame:
    """Rows of left with the number of rows in right, 0 included. right is counted before the join."""
    n = right.groupBy(on).agg(F.count(counted).alias(name))
    return left.join(n, on, "left").fillna(0, [name])


def resolve_in_order(rows: DataFrame, *lookups: tuple[DataFrame, str, str], value: str, name: str) -> DataFrame:
    """The value of the first lookup (table, its key, the column of rows) that has the row's key."""
    found = []
    for i, (table, key, column) in enumerate(lookups):
        side = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        rows = rows.join(side, rows[column] == side[f"_k{i}"], "left")
        found.append(f"_v{i}")
    return rows.withColumn(name, F.coalesce(*found)).drop(*found, *[f"_k{i}" for i in range(len(lookups))])


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, kind: str, unknown: str = "unknown") -> DataFrame:
    """One row per key: the old kind unless it's unknown, else the new one."""
    o, n = old.select(key, F.col(kind).alias("_old")), new.select(key, F.col(kind).alias("_new"))
    return o.join(n, key, "full").select(key, F.coalesce(F.when(F.col("_old") != unknown, F.col("_old")), "_new", "_old").alias(kind))


def within_budget(rows: DataFrame, group: str, order: list, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Of each group, the first rows in order while their number and running size stay within the budget.

    The number alone cuts first, before rows of a group meet; so no task holds more than ``most_rows`` of it.
    """
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most_rows)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_bytes", running).filter(F.col("_bytes") <= most_bytes).drop("_n", "_bytes")


def overlapping(spans: DataFrame, periods: DataFrame, width: int = 32) -> DataFrame:
    """Spans (start_year, end_year) with each period (first_year, last_year) that they overlap.

    Both sides are cut into bins of ``width`` years and joined on equal bins; an overlap counts in the
    first bin that both have, so it is one row. Rows grow with the length of the intervals and with
    the overlaps; a crowded bin is a skewed key that adaptive execution splits. Nulls overlap nothing.
    """
    number = lambda year: F.floor(year / width)
    low = lambda a, b: number(F.least(a, b))
    binned = lambda rows, a, b: rows.withColumn("_bin", F.explode(F.sequence(low(F.col(a), F.col(b)), number(F.greatest(a, b)))))
    start, end, first, last = (F.col(c) for c in ("start_year", "end_year", "first_year", "last_year"))
    spans, periods = (rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()) for rows, a, b in ((spans, "start_year", "end_year"), (periods, "first_year", "last_year")))
    met = binned(spans, "start_year", "end_year").join(binned(periods, "first_year", "last_year"), "_bin")
    once = F.col("_bin") == F.greatest(low(start, end), low(first, last))
    return met.filter(once & (end >= first) & (start <= last)).drop("_bin")


def running_total(rows: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows up to each in ``order`` (unique): sums of ranges first, then within them, so no task sees all rows."""
    dealt = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_run", F.sum(size).over(within)).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_run")).drop("_part", "_run", "_before")


def duplicates(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """key, n, first id of keys that several rows have."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).filter("n > 1")


PLACES = ("title", "abstract", "author", "keyword")


def grams(word: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a word."""
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, F.lit(size)))))


def alias_hits(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The documents (their columns, words: distinct) with subject, alias, folded of each alias that they may have, as part of a word or over several; once for each word that has the alias's longest.

    The longest word of an alias lies within a word of any text that has the alias. So the index is
    over distinct words: each is posted under its pieces of three characters, an alias is looked up
    under the rarest piece of its longest word, and what contains the word goes on to the documents.
    Work grows with the distinct words and the hits, not with documents times aliases. The words that
    have an alias are a table: small, it is sent to the documents, which then don't move.
    """
    every = F.filter(F.split("folded", " "), lambda w: w != "")
    longest = F.array_max(F.transform(every, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    known = known.withColumn("probe", longest).filter("probe is not null").withColumn("size", F.least(F.lit(3), F.length("probe")))
    words = texts.withColumn("word", F.explode("words")).drop("words")
    vocabulary = words.select("word").distinct()
    pieces = reduce(lambda a, b: a.when(F.col("size") == b, grams(F.col("probe"), b)), (2, 3), F.when(F.col("size") == 1, F.array("probe")))
    asked = known.withColumn("gram", F.explode(pieces))
    sizes = [r.size for r in known.select("size").distinct().collect()]  # three at most
    posted = reduce(DataFrame.unionByName, [vocabulary.select("word", F.explode(grams(F.col("word"), n)).alias("gram")) for n in sizes or [3]])
    frequency = posted.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(frequency, "gram", "left").groupBy("subject", "alias", "folded", "probe").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    pairs = posted.join(rarest, "gram").filter(F.contains("word", F.col("probe"))).select("word", "subject", "alias", "folded")
    return words.join(written(pairs, "words"), "word").drop("word")


def match_subjects(docs: DataFrame, aliases: DataFrame, low: int = 30) -> DataFrame:
    """(doc_id, subject, relation, score, evidence): subjects that a document is about or by.

    docs: doc_id (unique), title, abstract, author, keyword. aliases: subject, alias, of three bytes at
    least; blank ones match nothing. Candidates come from an index over the distinct words
    (``alias_hits``) and are confirmed on the whole texts. Hundredths: title 45, abstract 25 (one-word
    alias: 35), keyword 15, author 35; ``low`` in all at least, 100 at most.
    """
    known = aliases.select("subject", "alias", fold(F.col("alias")).alias("folded")).filter(F.octet_length("alias") >= 3).distinct()
    texts = docs.select("doc_id", *[F.coalesce(fold(F.col(c)), F.lit("")).alias(c) for c in PLACES])
    words = F.filter(F.array_distinct(F.split(F.concat_ws(" ", *PLACES), " ")), lambda w: w != "")
    rows = alias_hits(texts.withColumn("words", words), known)
    within = lambda c: F.contains(F.col(c), F.col("folded"))
    one = F.when(F.contains("alias", F.lit(" ")), 25).otherwise(35)
    points = {"title": F.lit(45), "abstract": one, "author": F.lit(35), "keyword": F.lit(15)}
    found = rows.groupBy("doc_id", "subject").agg(*[F.max(F.when(within(c), n)).alias(c) for c, n in points.items()])
    z = lambda c: F.coalesce(c, F.lit(0))
    total = z("title") + z("abstract") + z("author") + z("keyword")
    names = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("title", "abstract", "keyword", "author")])
    found = found.withColumn("score", F.least(F.lit(100), total)).filter(F.col("score") >= low)
    return found.select("doc_id", "subject", F.when(F.col("author").isNotNull(), "by").otherwise("about").alias("relation"), "score", names.alias("evidence"))


def bottleneck(stages: list[tuple[str, Column]]) -> Column:
    """The name of the stage with the smallest count; ties go to the first."""
    return F.array_min(F.array(*[F.struct(c.alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(stages)]))["name"]
