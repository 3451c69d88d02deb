"""Mining of sentences: who, when, where and what, with years and places carried over from earlier sentences of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import has_alone, has_any
from annals.functions.place import LOWER, UPPER, best_in_text, of_page
from annals.functions.time import last_year
from annals.operators.assembly import carried
from annals.operators.judge import others_death


def subject_of(low: Column, page: Column) -> Column:
    """The place in rules.SUBJECTS of the first subject whose alias the sentence names, else of the first that the page is about; null without one. In lower case."""
    out = None
    for i, (_, aliases, _, _, _) in enumerate(rules.SUBJECTS):
        out = (F if out is None else out).when(has_alone(low, aliases), i)
    for i, (title, _, parts, _, _) in enumerate(rules.SUBJECTS):
        out = out.when((page == title.translate(str.maketrans(UPPER, LOWER))) | has_any(page, parts), i)
    return out


def of_subject(subject: Column, k: int) -> Column:
    return F.try_element_at(F.array(*[F.lit(s[k]) for s in rules.SUBJECTS]), subject + 1)


def first_cue(low: Column) -> Column:
    """The verb of the first cue that the sentence has."""
    cues = F.array(*[F.struct(F.lit(c).alias("cue"), F.lit(v).alias("verb")) for c, v in rules.MINED_VERBS])
    return F.try_element_at(F.filter(cues, lambda x: F.contains(low, x["cue"])), F.lit(1))["verb"]


def year_surface(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BC"))).otherwise(F.lpad(year.cast("string"), 4, "0"))


def resolved(rows: DataFrame, text: str, page: str) -> DataFrame:
    """Adds subject (place in rules.SUBJECTS), own_year within the subject's window, own_place."""
    rows = rows.withColumns({"_low": F.translate(F.trim(text), UPPER, LOWER), "_page": F.translate(F.coalesce(page, F.lit("")), UPPER, LOWER)})
    rows = rows.withColumn("subject", subject_of(F.col("_low"), F.col("_page")))
    window = [of_subject(F.col("subject"), k) for k in (3, 4)]
    place = F.coalesce(best_in_text(F.col(text), "title"), of_page(F.coalesce(page, F.lit(""))))
    return rows.withColumns({"own_year": last_year(F.col("_low"), *window), "own_place": F.when(F.col("subject").isNotNull(), place)})


def mined(rows: DataFrame, text: str, page: str, keys: list[str], order: str) -> DataFrame:
    """One candidate of a sentence at most: rows with person, time, place, verb, extractor.

    Years and places carry on along ``order`` within ``keys`` (the page, and its section if the carry ends with
    headings); sentences under 20 bytes or about memorials pass none on. A sentence that takes one from before has to
    name the subject or say he, she or they. Anecdotes come first; memorials and sentences under 28 bytes give nothing.
    """
    rows = resolved(rows, text, page)
    size, memory = F.octet_length(F.trim(text)), has_any(F.col("_low"), rules.MINED_MEMORY)
    passes = (size >= 20) & ~memory & F.col("subject").isNotNull()
    rows = carried(rows, keys, order, _year=F.when(passes, F.col("own_year")), _place=F.when(passes, F.col("own_place")))
    low, high = (of_subject(F.col("subject"), k) for k in (3, 4))
    rows = rows.withColumns(
        {
            "year": F.coalesce("own_year", F.when(F.col("_year").between(low, high), F.col("_year"))),
            "place": F.coalesce("own_place", "_place"),
            "_carry": F.col("own_year").isNull() | F.col("own_place").isNull(),
            "_tale": has_any(F.col("_low"), rules.MINED_ANECDOTES),
            "_cue": F.when(~memory, first_cue(F.col("_low"))),
        }
    )
    rows = rows.filter((size >= 28) & F.col("subject").isNotNull() & F.col("year").isNotNull() & F.col("place").isNotNull() & (F.col("_tale") | F.col("_cue").isNotNull()))
    s = F.col("subject")
    aliased = lambda test: F.coalesce(*[F.when(s == i, test(x[1])) for i, x in enumerate(rules.SUBJECTS)])
    hook = aliased(lambda names: has_alone(F.col("_low"), names)) | has_alone(F.col("_low"), rules.PRONOUNS)
    rows = rows.filter(~F.col("_carry") | hook)
    alive = aliased(lambda names: ~any_of([died(F.col("_low"), n) for n in names]))
    grieved = (F.col("_cue") == "died") & alive & others_death(F.lit("died"), F.col("_low"), F.lit("\0"))
    return rows.withColumns(
        {
            "person": of_subject(s, 0),
            "time": year_surface(F.col("year")),
            "verb": F.when(F.col("_tale"), "anecdoted").when(grieved, "grieved").otherwise(F.col("_cue")),
            "extractor": F.when(F.col("_tale"), "dump:anecdote").otherwise("dump_keywords"),
        }
    ).drop("_low", "_page", "_year", "_place", "_carry", "_tale", "_cue", "own_year", "own_place")


def died(low: Column, name: str) -> Column:
    return has_any(low, [f"{name} died", f"{name} drowned", f"death of {name}", f"{name}'s death"])


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
