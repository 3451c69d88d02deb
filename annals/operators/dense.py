"""Events from dense prose: sentences, their clauses, and one candidate for each clause with a predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions.time import time_surface
from annals.operators.judge import predicate_of

#: Cues of places; a later one in the list goes before the earlier ones.
PLACE_CUES = [" in ", " at ", " to ", " on ", " near "]
SKIPPED = ["structured_statement", "chronology_list"]


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def clauses(pages: DataFrame, key: str, text: str) -> DataFrame:
    """One row per clause: sentence_index, clause_index, clause_text, start_offset, end_offset (bytes).

    Sentences end with a full stop or a line end, clauses with a semicolon or a full stop; empty ones are left out.
    A sentence starts where the trimmed lengths of the earlier ones and one byte for each put it. Null texts have no
    clauses; ``key`` identifies the rows of pages, whose other columns stay.
    """
    marked = F.regexp_extract_all(text, F.lit(r"([^.\n]*[.\n]|[^.\n]+)"), 1)
    sentences = pages.select("*", F.posexplode(F.filter(F.transform(marked, stripped), lambda s: s != "")).alias("sentence_index", "_sentence"))
    parts = sentences.select("*", F.posexplode(F.split("_sentence", "[;.]")).alias("_part", "_clause"))
    size = F.octet_length("_clause") + 1
    sentence_size = F.octet_length("_sentence") + 1
    by_sentence = Window.partitionBy(key).orderBy("sentence_index")
    within = Window.partitionBy(key, "sentence_index").orderBy("_part")
    upto = F.sum(F.when(F.col("_part") == 0, sentence_size).otherwise(0)).over(by_sentence) - sentence_size
    rows = parts.withColumn("_from", upto).withColumn("_at", F.col("_from") + F.sum(size).over(within) - size)
    kept = F.sum(F.when(stripped(F.col("_clause")) != "", 1).otherwise(0)).over(within)
    rows = rows.withColumn("clause_index", (kept - 1).cast("int")).withColumn("clause_text", stripped(F.col("_clause"))).filter("clause_text <> ''")
    offsets = {"start_offset": F.col("_at").cast("int"), "end_offset": (F.col("_at") + F.octet_length("_clause")).cast("int")}
    return rows.withColumns(offsets).drop("_sentence", "_part", "_clause", "_from", "_at")


def bare(s: Column) -> Column:
    """Without blanks around, and without other characters than letters, blanks, hyphens and apostrophes at the ends."""
    return F.regexp_replace(F.trim(s), r"^[^\p{IsAlphabetic} '\-]+|[^\p{IsAlphabetic} '\-]+$", "")


def place_after_cue(clause: Column) -> Column:
    """What stands after the last cue, up to a digit, a mark or one of the first three cues; null without a name of two bytes."""

    def last(cue: str) -> Column:
        found = F.regexp_extract_all(clause, F.lit(f"(?i){cue}(?=([^.;,0-9]*))"), 1)
        names = F.transform(found, lambda x: bare(F.regexp_replace(x, "( in | at | to ).*$", "")))
        return F.try_element_at(F.filter(names, lambda x: F.octet_length(x) >= 2), F.lit(-1))

    return F.coalesce(*[last(c) for c in reversed(PLACE_CUES)])


def place_in_clause(clause: Column) -> Column:
    """The longest name of the list of clause places whose first occurrence is a word of its own."""
    low = F.lower(clause)

    def alone(name: str) -> Column:
        at = F.instr(low, name)
        before, after = F.substring(low, at - 1, F.lit(1)), F.substring(low, at + len(name), F.lit(1))
        return (at > 0) & ~((at > 1) & before.rlike("[a-z0-9]")) & ~after.rlike("[a-z0-9]")

    longest = sorted(rules.CLAUSE_PLACES, key=lambda p: -len(p.encode()))  # stable: of equal ones the first
    return F.coalesce(*[F.when(alone(p), p) for p in longest])


def spouse(clause: Column) -> Column:
    """The name after the first " married ", up to a mark, " in " or " at "; null without one."""
    after = F.trim(F.regexp_extract(clause, r"(?i) married (.*)$", 1))
    name = bare(F.regexp_replace(F.regexp_replace(after, "( in | at ).*$", ""), "[.;,].*$", ""))
    return F.nullif(name, F.lit(""))


def subject_of(title: Column, clause: Column) -> Column:
    """The title up to a bracket; without one the first run of capitalized words, else Unknown."""
    base = F.trim(F.split_part(title, F.lit("("), F.lit(1)))
    words = F.transform(F.filter(F.split(clause, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\-]+|[^\p{IsAlphabetic}\-]+$", ""))
    capital = lambda w: w.rlike(r"^\p{Lu}")
    first = F.array_position(F.transform(words, capital), F.lit(True))
    tail = F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words))
    stop = F.array_position(F.transform(tail, capital), F.lit(False))
    run = F.slice(tail, F.lit(1), F.when(stop == 0, F.size(tail)).otherwise(stop - 1).cast("int"))
    spoken = F.contains(F.lower(clause), F.lit("he "))
    return F.when((base != "") | (title.isNotNull() & spoken), base).when(first > 0, F.array_join(run, " ")).otherwise("Unknown")


def dense_clauses(pages: DataFrame, key: str, text: str, title: str, kind: str | None = None) -> DataFrame:
    """Candidates of pages: clause columns, event_type, predicate, subject_surface, time_surface, place_surface, object_surface.

    Pages whose kind is a list of statements or a chronology are left to their own readers. A clause gives at most one
    candidate and takes nothing from its neighbours.
    """
    if kind is not None:
        pages = pages.filter(F.col(kind).isNull() | ~F.col(kind).isin(SKIPPED))
    clause = F.col("clause_text")
    rows = clauses(pages, key, text).withColumns({"event_type": predicate_of(clause, 1), "predicate": predicate_of(clause, 2)}).filter("event_type is not null")
    rows = rows.withColumns({"_place": place_after_cue(clause), "_object": spouse(clause)})
    return rows.withColumns(
        {
            "subject_surface": subject_of(F.col(title), clause),
            "time_surface": time_surface(clause),
            "object_surface": F.when(~F.col("_object").eqNullSafe(F.col("_place")), F.col("_object")),
            "place_surface": F.coalesce("_place", place_in_clause(clause)),
        }
    ).drop("_place", "_object")
