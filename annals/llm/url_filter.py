"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything here is DataFrame functions. The model learns from a small labelled table of URLs by
gradient descent: each step joins the sample's n-grams with the weights, sums margins by URL and
gradients by bucket. The weights are one array of ``1 << BITS`` doubles, however large the input;
pages are judged where they are read, with that array as a constant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

BITS = 12  # 4,096 buckets: 32 kB of weights
SIZES = (3, 4)  # characters of an n-gram
#: (rule, allow)
RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str) -> Column:
    """Whether the rule's host is host or above it, and path starts with the rule's path."""
    name, slash, rest = rule.partition("/")
    under = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
    return under & F.startswith(F.col("path"), F.lit(slash + rest)) if slash else under


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and whether it allows; nulls if none does. Ties go to the rule that sorts first."""
    order = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda value: reduce(lambda c, r: c.when(fits(r[0]), F.lit(value(r))), order[1:], F.when(fits(order[0][0]), F.lit(value(order[0]))))
    return pick(lambda r: r[0]), pick(lambda r: r[1])


def bucket_of(mark: str):
    return lambda gram: F.pmod(F.xxhash64(F.concat(F.lit(mark), gram)), F.lit(1 << BITS)).cast("int")


def gram_buckets() -> Column:
    """Distinct buckets of the n-grams of ^host$ and ^path$; a text's n-grams are its overlapping matches."""
    parts = []
    for mark, column in (("h", "host"), ("p", "path")):
        text = F.concat(F.lit("^"), F.col(column), F.lit("$"))
        for n in SIZES:
            grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
            parts.append(F.transform(grams, bucket_of(f"{mark}{n}:")))
    return F.array_distinct(F.concat(*parts))


def parse(pages: DataFrame, *keep: str) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(*keep, host(url).alias("host"), path(url).alias("path"))


def labelled_sample(pages: DataFrame, rules=RULES, most: int = 2000) -> DataFrame:
    """A small labelled table: host, path, label of URLs that rules decide.

    Bound: the ``most`` distinct (host, path) with the smallest hashes.
    """
    known = parse(pages).withColumn("label", ruled(rules)[1].cast("int")).filter("label is not null").distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)


def train(labelled: DataFrame, steps: int = 12, rate: float = 4.0, decay: float = 1e-3) -> DataFrame:
    """One row: bias and weights (array of 1 << BITS), by gradient descent with momentum on the mean logistic loss.

    labelled: host, path, label (1: allow). Without rows all weights are 0.
    """
    rows = cut(labelled.select(F.xxhash64("host", "path").alias("row"), F.col("label").cast("double").alias("y"), gram_buckets().alias("grams")), "urls")
    n = max(1, rows.count())
    size = F.sqrt(F.greatest(F.lit(1), F.size("grams")))  # rows have unit length
    x = rows.select("row", "y", (1 / size).alias("x"), F.explode("grams").alias("bucket"))
    # the bias is bucket -1
    x = cut(x.union(rows.select("row", "y", F.lit(1.0).alias("x"), F.lit(-1).alias("bucket"))), "url-grams")
    w = cut(x.select("bucket").distinct().select("bucket", F.lit(0.0).alias("w"), F.lit(0.0).alias("m")), "weights")
    for _ in range(steps):
        margin = x.join(w, "bucket").groupBy("row").agg(F.sum(F.col("x") * F.col("w")).alias("z"))
        slope = x.join(margin, "row").groupBy("bucket").agg((F.sum(F.col("x") * (1 / (1 + F.exp(-F.col("z"))) - F.col("y"))) / n).alias("g"))
        momentum = 0.8 * F.col("m") + F.col("g") + decay * F.col("w")
        w = cut(w.join(slope, "bucket").select("bucket", (F.col("w") - rate * momentum).alias("w"), momentum.alias("m")), "weights")
    by_bucket = F.map_from_entries(F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "w"))))
    place = F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda b: F.coalesce(F.try_element_at(F.col("by_bucket"), b), F.lit(0.0)))
    model = w.agg(by_bucket.alias("by_bucket"), F.sum(F.when(F.col("bucket") < 0, F.col("w"))).alias("bias"))
    return model.select(F.coalesce("bias", F.lit(0.0)).alias("bias"), place.alias("weights"))


def judge(pages: DataFrame, model: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A page gets its rule's verdict; without a rule, allow if the model's score is at least 0.5.
    Null urls and those without :// have empty host and path and the score of the model's bias and
    marks alone; very long urls are read whole; repeated rows are judged each; an empty table gives
    no rows. Other columns of pages are not looked at.
    """
    rule, allowed = ruled(rules)
    model = cut(model, "url-model")
    weights, bias = model.select("weights").scalar(), model.select("bias").scalar()
    rows = parse(pages, "page_id").withColumns({"rule": rule, "allowed": allowed, "grams": gram_buckets()})
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.element_at(F.col("weights"), b + 1)) / F.sqrt(F.greatest(F.lit(1), F.size("grams")))
    scored = rows.withColumns({"weights": weights, "bias": bias}).withColumn("score", 1 / (1 + F.exp(-(F.col("bias") + total))))
    verdict = F.when(F.coalesce("allowed", F.col("score") >= 0.5), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """judge() with a model trained on ``labelled`` (host, path, label) or else on labelled_sample(pages)."""
    return judge(pages, train(labelled if labelled is not None else labelled_sample(pages, rules)), rules)
