"""Dossiers: what sources say about an event, as a short paragraph with numbered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import has_any

CLAIMS, SECTION_CLAIMS, PARTS, LONG = 6, 5, 5, 850
DROPPED = r"\[(?:[0-9\s]*|\s*(?:[^\]\s\x{80}-\x{10FFFF}]\s*){0,2}|\s*[\x{80}-\x{7FF}]\s*|(?i:\s*r\s*[eé]\s*f[^\]]*)|(?i:[^\]]*c\s*i\s*t\s*a\s*t\s*i\s*o\s*n[^\]]*))\]"


def claim_text(text: Column) -> Column:
    """Entities decoded, brackets with numbers, references or two bytes taken out, white space collapsed."""
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(F.regexp_replace(text, DROPPED, ""), r"\s+", " "))


def identity_blurb(text: Column) -> Column:
    """Short sentences that only say what somebody was."""
    low = F.lower(text)
    return has_any(low, ["was a ", "is a ", "was an "]) & (F.octet_length(low) < 140) & ~has_any(low, ["born", "died"])


def claim_key(text: Column) -> Column:
    """The first twelve words without marks: claims that share it are one."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: w != "")
    return F.lower(F.array_join(F.slice(words, 1, 12), " "))


def by_type(event_type: Column, table: list[tuple], test) -> Column:
    out = None
    for kind, parts in table:
        if kind is None:
            return out.otherwise(test(parts))
        out = F.when(event_type == kind, test(parts)) if out is None else out.when(event_type == kind, test(parts))
    return out


def section_fits(title: Column, event_type: Column) -> Column:
    low = F.lower(title)
    return by_type(event_type, rules.EVENT_SECTIONS, lambda parts: has_any(low, parts))


def worded(low: Column) -> Column:
    """For each entry of rules.EVENT_WORDS whether a sentence in lower case has one of its words."""
    return F.array(*[has_any(low, parts) for _, parts in rules.EVENT_WORDS])


def relevant(low: Column, words: Column, event_type: Column, place: Column, year: Column) -> Column:
    """Whether a sentence in lower case has the place (lower case), the year (as text) or a word of the event's type; ``words`` says of which types it has words."""
    named = F.coalesce((F.trim(place) != "") & F.contains(low, place), F.lit(False)) | F.coalesce(F.contains(low, year), F.lit(False))
    number = [(kind, i) for i, (kind, _) in enumerate(rules.EVENT_WORDS)]
    return named | by_type(event_type, number, lambda i: words[i])


def without_heading(text: Column, title: Column, marks: str) -> Column:
    """text without the title of its section in front, as such, with a blank or with a full stop. Every step names its input once, which keeps plans small."""
    quoted = F.regexp_replace(title, r"([^\p{L}\p{N}\s])", r"\\$1")
    text = F.trim(text)
    for end in ("", " ", r"\."):
        text = F.regexp_replace(text, F.concat(F.lit("^"), quoted, F.lit(f"{end}[{marks}]*")), F.lit(""))
    return text


def compact(text: Column, title: Column) -> Column:
    """Without headings in front; of more than 200 characters the first sentence, if it has 48."""
    text = without_heading(text, title, " ")
    for heading in rules.LEFTOVER_HEADINGS:
        text = F.regexp_replace(text, f"^{heading}[ :—-]*", "")
    text = F.regexp_replace(text, r"(?s)^(?=.{201})((?:(?!\. ).){48,})\. .*$", r"$1.")
    return F.regexp_replace(F.trim(text), ",+$", "")


def frame(language: Column, event_type: Column, person: Column, place: Column, year: Column) -> Column:
    """The sentence that frames the event; null without a year or a place."""
    out = None
    for lang, kind, said in rules.FRAMES:
        fits = ((language == "fr") if lang == "fr" else (language != "fr")) & (F.lit(True) if kind is None else event_type == kind)
        text = F.replace(F.replace(F.replace(F.lit(said), F.lit("{place}"), F.trim(place)), F.lit("{year}"), year.cast("string")), F.lit("{person}"), person)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.when(year.isNotNull() & (F.trim(place) != ""), out)


def page_url(language: Column, title: Column, revision: Column) -> Column:
    """Address of a page, or of a revision of it if one is known."""
    host, name = F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/w")), F.replace(title, F.lit(" "), F.lit("_"))
    old = F.concat(host, F.lit("/index.php?title="), name, F.lit("&oldid="), revision.cast("string"))
    return F.when(revision.isNotNull(), old).otherwise(F.concat(host, F.lit("iki/"), name))


def claims(events: DataFrame, narrative: DataFrame, sentences: DataFrame) -> DataFrame:
    """At most six claims an event: event_id, place_in (0 on), text, section.

    The fact comes first, then neighbours of the evidence (narrative: event_id, ordinal, text, is_evidence), then up to five
    sentences of two sections of the page (sentences: page, section_no, section, ordinal, text): the first section that goes
    with the event and the first of the others. A sentence whose key came before isn't taken again. Ranks are limited
    before rows meet by event, so a page with very many sentences is cut where it lies.
    """
    order = ["kind", "first", "second", "text"]
    fact = events.filter("trim(coalesce(fact, '')) <> ''").select("event_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second"), claim_text(F.trim("fact")).alias("text"), F.lit("evidence").alias("section"))
    near = narrative.filter(~F.col("is_evidence") & ~identity_blurb(F.col("text")))
    near = near.select("event_id", F.lit(1).alias("kind"), F.col("ordinal").cast("long").alias("first"), F.lit(0).cast("long").alias("second"), claim_text(F.col("text")).alias("text"), F.concat(F.lit("adjacent · sentence "), "ordinal").alias("section"))
    near = near.filter("char_length(text) >= 24")
    about = events.select("event_id", "page", "event_type", "place_label", "year")
    titles = sentences.groupBy("page", "section_no").agg(F.min("section").alias("section"))
    pairs = titles.join(about, "page").withColumn("_fits", section_fits(F.col("section"), F.col("event_type")))
    best = F.min(F.when(F.col("_fits"), F.col("section_no"))).over(Window.partitionBy("event_id"))
    pairs = pairs.withColumn("_other", (~F.col("section_no").eqNullSafe(best)).cast("int"))
    chosen = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("event_id").orderBy("_other", "section_no"))).filter("_rank <= 2")
    # what a sentence says depends on no event: it is cleaned and judged once, before it meets the events of its page
    plain = sentences.select("page", "section_no", "ordinal", without_heading(claim_text(F.col("text")), F.col("section"), " :—-").alias("text"))
    plain = plain.filter(F.char_length("text").between(40, 320) & ~identity_blurb(F.col("text"))).withColumn("_low", F.lower("text"))
    plain = plain.withColumn("_words", worded(F.col("_low")))
    asked = chosen.select("event_id", "page", "section_no", "section", "event_type", F.lower("place_label").alias("_place"), F.col("year").cast("string").alias("_year"), "_rank")
    said = asked.join(plain, ["page", "section_no"]).filter(relevant(F.col("_low"), F.col("_words"), F.col("event_type"), F.col("_place"), F.col("_year")))
    said = said.select("event_id", F.lit(2).alias("kind"), F.col("_rank").cast("long").alias("first"), F.col("ordinal").cast("long").alias("second"), "text", "section")
    said = said.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).filter(f"_n <= {SECTION_CLAIMS}").drop("_n")
    # of the local ones the first six are enough, whatever follows
    local = fact.unionByName(near).withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy(*order)))
    rows = local.filter(f"_n <= {CLAIMS}").drop("_n").unionByName(said)
    again = F.row_number().over(Window.partitionBy("event_id", "_key").orderBy(*order))
    rows = rows.withColumn("_key", claim_key(F.col("text"))).withColumn("_again", again).filter("kind < 2 or _again = 1")
    rows = rows.withColumn("place_in", F.row_number().over(Window.partitionBy("event_id").orderBy(*order)) - 1).filter(f"place_in < {CLAIMS}")
    return rows.select("event_id", "place_in", "text", "section")


def dossiers(events: DataFrame, narrative: DataFrame, sentences: DataFrame) -> DataFrame:
    """event_id, event_summary, how_it_happened, source_refs (array of citation_index, label, section_title, snippet, url).

    events: event_id, event_type, year, place_label, person, title, summary, fact, page, language, revision. Events
    without claims get their fact, summary or title and no sources.
    """
    found = claims(events, narrative, sentences).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place_in", "text", "section"))).alias("_all"))
    rows = events.join(found, "event_id", "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<struct<place_in:int,text:string,section:string>>")))
    local = F.filter("_all", lambda c: (F.col("language") == "fr") & has_any(F.lower(c["section"]), rules.BIOGRAPHIC_SECTIONS))
    rows = rows.withColumn("_woven", F.when(F.size(local) >= 3, local).otherwise(F.col("_all")))
    numbered = F.transform("_woven", lambda c, i: F.struct((i + 1).alias("n"), compact(c["text"], c["section"]).alias("said")))
    rows = rows.withColumns({"_said": numbered, "_lead": frame(F.col("language"), F.col("event_type"), F.col("person"), F.col("place_label"), F.col("year"))})
    first = F.lower(F.try_element_at("_said", F.lit(1))["said"])
    number = F.try_element_at(F.filter(F.transform(F.split("_lead", r"\s+"), lambda w: F.regexp_replace(w, "[^0-9]", "")), lambda d: F.length(d) == 4), F.lit(1))
    covered = F.coalesce((first != "") & F.contains(first, number) & has_any(first, rules.FRAMED_WORDS), F.lit(False))
    lead = F.when(~covered, F.col("_lead"))
    parts = F.transform(F.filter("_said", lambda c: c["said"] != ""), lambda c: F.concat(c["said"], F.lit("["), c["n"].cast("string"), F.lit("]")))
    rows = rows.withColumn("_parts", F.slice(F.concat(F.array_compact(F.array(lead)), parts), 1, PARTS))
    woven = F.aggregate("_parts", F.lit(""), lambda a, p: F.when(F.length(a) > LONG, a).otherwise(F.when(a == "", p).otherwise(F.concat(a, F.lit(" "), p))))
    keys = F.transform("_woven", lambda c: claim_key(c["text"]))
    rest = F.filter("_all", lambda c: ~F.array_contains(keys, claim_key(c["text"])))
    url = page_url(F.col("language"), F.col("page"), F.col("revision"))
    refs = F.transform(
        F.concat("_woven", rest),
        lambda c, i: F.struct(
            (i + 1).alias("citation_index"), F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Wikipedia — "), "page").alias("label"), c["section"].alias("section_title"), c["text"].alias("snippet"), url.alias("url")
        ),
    )
    nothing, fallback = F.size("_all") == 0, F.coalesce("fact", "summary", "title")
    return rows.select(
        "event_id",
        F.when(nothing, fallback).otherwise(F.coalesce(F.nullif(F.trim("fact"), F.lit("")), F.try_element_at("_woven", F.lit(1))["text"])).alias("event_summary"),
        F.when(nothing, fallback).otherwise(woven).alias("how_it_happened"),
        refs.alias("source_refs"),
    )
