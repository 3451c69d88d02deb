"""Debates, controversies and theories in prose, in sections and in titles of works. They never become events."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import first_rule, has_any
from annals.functions.text import let

LEAST_BYTES = 24
HIT = ["debate_type", "evidence_layer", "claim_kind", "epistemic_status"]


def debate_section(title: Column) -> Column:
    """Whether a section of this title is searched."""
    low = F.lower(title)
    skipped = has_any(low, rules.SKIPPED_SECTIONS) & ~has_any(low, rules.KEPT_SECTIONS)
    return ~skipped & has_any(low, rules.DEBATE_SECTIONS)


def loose_cuts(text: str | None) -> list[str]:
    """Sentences by . ! ? or line end; one with fewer than 24 bytes goes on with the next, and is left out at the end."""
    out, start, text = [], 0, text or ""
    for end in [m.end() for m in re.finditer(r"[.!?\n]", text)] + [len(text)]:
        piece = text[start:end].strip()
        if len(piece.encode("utf-8", "surrogatepass")) >= LEAST_BYTES:
            out.append(piece)
        if out and out[-1] is piece or not piece:
            start = end
    return out


def loose_sentences(text: Column) -> Column:
    """Array of loose sentences. In Python, since a cut depends on all cuts before it; Arrow batches."""

    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(loose_cuts)

    return F.pandas_udf(cuts, "array<string>")(text)


def fits(low: Column):
    def test(lists: list[list[str]]) -> Column:
        hit = has_any(low, lists[0])
        for parts in lists[1:]:
            hit = hit & has_any(low, parts)
        return hit

    return test


def as_hit(rule: Column, table: list[tuple], quote: Column, event: Column) -> Column:
    """The hit of a rule's number as a struct; null without one."""
    of = lambda r, k: F.element_at(F.array(*[F.lit(x[k]) for x in table]), r + 1)
    return let(rule, lambda r: F.when(r.isNotNull(), F.struct(*[of(r, i).alias(n) for i, n in enumerate(HIT, 1)], quote.alias("quote"), event.alias("event_type"))))


def numbered(table: list[tuple]) -> list[tuple]:
    return [(r[0], i) for i, r in enumerate(table)]


def sentence_hit(sentence: Column) -> Column:
    return let(F.lower(sentence), lambda low: as_hit(first_rule(numbered(rules.DEBATES), fits(low), 1), rules.DEBATES, sentence, first_rule(rules.DEBATED_EVENTS, fits(low), 1)))


def title_hit(title: Column) -> Column:
    """Titles below eight bytes say nothing."""
    low = F.lower(title)
    rule = F.when(F.octet_length(F.trim(low)) >= 8, first_rule(numbered(rules.DEBATED_TITLES), fits(low), 1))
    event = F.element_at(F.array(*[F.lit(r[5]) for r in rules.DEBATED_TITLES]), rule + 1)
    return as_hit(rule, rules.DEBATED_TITLES, F.trim(title), event)


def passage_hits(rows: DataFrame, text: str) -> DataFrame:
    """rows and, for each sentence of text that tells of a debate: ordinal (of the hit), debate_type, evidence_layer, claim_kind, epistemic_status, quote, event_type."""
    found = rows.withColumn("_said", loose_sentences(F.col(text)))
    hits = F.filter(F.transform("_said", sentence_hit), lambda h: h.isNotNull())
    return found.withColumn("_hits", hits).select(*rows.columns, F.posexplode("_hits").alias("ordinal", "_hit")).select(*rows.columns, "ordinal", "_hit.*")


def work_hits(works: DataFrame, title: str, abstract: str) -> DataFrame:
    """The same for works: title and abstract are one passage; where no sentence of it fits, the title alone may."""
    blob = F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", F.concat(F.col(title), F.lit(". "), F.col(abstract))).otherwise(F.col(title))
    found = works.withColumn("_said", loose_sentences(blob))
    hits = F.filter(F.transform("_said", sentence_hit), lambda h: h.isNotNull())
    of_title = F.array_compact(F.array(title_hit(F.col(title))))
    found = found.withColumn("_hits", hits).withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(of_title))
    return found.select(*works.columns, F.posexplode("_hits").alias("ordinal", "_hit")).select(*works.columns, "ordinal", "_hit.*")


def source_plan(subjects: DataFrame, most: int = 40) -> DataFrame:
    """subjects: subject, classes, primary, military, languages, countries (arrays but for primary and military).
    One row per subject and source: source, priority, max_documents, reason; of a source that comes twice the first priority stays."""
    named = F.coalesce("primary", F.lit("unknown"))
    scholar = named.isin(rules.SCHOLARS)
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    french = F.exists(lists("languages"), lambda x: F.startswith(x, F.lit("fr"))) | F.exists(lists("countries"), lambda c: F.contains(F.lower(c), F.lit("france")) | F.contains(F.lower(c), F.lit("french")))
    gets = {"all": F.lit(True), "scholars": scholar, "french": french | scholar, "military": named == "military_leader"}
    facets = F.concat(F.when(F.col("military"), "military signal, ").otherwise(""), F.greatest(F.size(lists("classes")), F.lit(1)).cast("string"), F.lit(" facets"))
    reason = lambda t: F.replace(F.replace(F.lit(t), F.lit("{class}"), named), F.lit("{facets}"), facets)
    rows = [
        F.when(gets[who], F.struct(F.lit(p).alias("priority"), F.lit(k).alias("source"), F.least(F.lit(n), F.lit(most)).alias("max_documents"), reason(t).alias("reason")))
        for k, p, n, who, t in rules.PLANNED_SOURCES
    ]
    planned = subjects.withColumn("_plan", F.array_sort(F.array_compact(F.array(*rows)))).withColumn("_kinds", F.transform("_plan", lambda x: x["source"]))
    once = F.filter("_plan", lambda x, i: F.array_position("_kinds", x["source"]) == i + 1)
    return planned.select("subject", F.inline(once)).select("subject", "source", "priority", "max_documents", "reason")
