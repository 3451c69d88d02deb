"""Extractors: lines of text to candidates (event_type, predicate, year, place), each an ordered rule list over a line.

All take lines (page, line_no, line, death_year) and give the rows that a rule fits with event_type,
predicate, year and place. A year is the first run of exactly four digits from 1000 to 2100. A place
follows a cue word and ends at a digit or a mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals.functions import time
from annals.functions.classify import first_rule, has_any
from annals.functions.place import from_title, plausible
from annals.operators.judge import title_event_type

# Cues, event types and predicates must be these for right results.
TRAVEL = [
    (["departed", "left for", "partit"], "departure", "departed_for"),
    (["arrived", "arriva"], "arrival", "arrived_in"),
    (["lived in", "resided", "vécut", "vecut", "habita", "s'installa", "s’installa"], "residence", "resided_in"),
    (["stayed in", "stayed at"], "residence", "stayed_at"),
    (["exiled", "s'exila", "exilé"], "exile", "exiled_to"),
]
ITINERARY = [
    (["departed", "left for", "set out for", "sailed for", "embarked"], "departure", "departed_for"),
    (["arrived at", "arrived in", "entered ", "reached ", "landed at", "disembarked"], "arrival", "arrived_in"),
    (["passed through", "stopped at", "via "], "passage", "passed_through"),
    (["returned to"], "arrival", "returned_to"),
]
MOTION_CUES = [
    "departed for ", "left for ", "set out for ", "sailed for ", "arrived at ", "arrived in ", "landed at ", "passed through ", "stopped at ", "returned to ", "reached ",
    "entered ", "embarked for ", "disembarked at ",
]
MOTION_WORDS = [" for ", " to ", " at ", " through ", " via "]
PUBLICATION = ["published", "wrote ", "authored", "printed", "publia", "publié", "publie", "parut", "parution", "édita", "edita"]
COMMEMORATION = ["statue", "museum", "remains", "commemorat", "memorial", "reburied", "returned"]
MILITARY = [
    (["siege of", "besieged"], "siege", "besieged"),
    (["battle of", "fought at", "defeated", "victory at"], "battle", "fought_at"),
    (["retreated", "retreat from"], "retreat", "retreated_from"),
    (["surrender", "capitulat"], "surrender", "surrendered_at"),
    (["headquarters", "quartier général"], "headquarters", "hq_at"),
]
CAMPAIGN_BEGINS = ["began", "opened"]
TIMELINE = [
    (["battle", "siege"], "battle", "fought_at"),
    (["treaty", "peace"], "diplomatic", "signed"),
    (["coronation", "crowned"], "office", "held_office"),
    (["campaign", "retreat", "invade"], "military_campaign", "campaign_at"),
    (["remain", "posthumous", "returned"], "commemoration", "commemorated_at"),
]
PLACE_CUES = [" in ", " at ", " to ", " for ", " à ", " au ", " aux ", " en "]


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """The columns of pages but text, line_no and line."""
    rest = [c for c in pages.columns if c != text]
    return pages.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def first_year(line: Column) -> Column:
    """The first run of exactly four digits from 1000 to 2100."""
    runs = F.filter(F.split(line, "[^0-9]"), lambda r: F.length(r) == 4)
    return F.try_element_at(F.filter(F.transform(runs, lambda r: r.cast("int")), lambda y: y.between(1000, 2100)), F.lit(1))


def after(line: Column, cue: str, last: bool, stop: str) -> Column:
    """What follows the last (or first) occurrence of cue, up to a character of stop, trimmed; null if it has less than two bytes."""
    greed = ".*" if last else ".*?"
    found = F.trim(F.regexp_extract(line, f"(?is)^{greed}{cue}([^{stop}]*)", 1))
    return F.when(F.octet_length(found) >= 2, found)


def travel_place(line: Column) -> Column:
    out = []
    for cue in PLACE_CUES:
        s = F.regexp_replace(after(line, cue, True, ".0-9,"), r"^[^\p{L} -]+|[^\p{L} -]+$", "")
        s = F.trim(F.regexp_replace(F.regexp_replace(s, "( en)+$", ""), "( in)+$", ""))
        out.append(F.when((F.octet_length(s) >= 2) & (F.lower(s) != "en"), s))
    return F.coalesce(*out)


def motion_place(line: Column) -> Column:
    tail = lambda s: F.trim(F.regexp_replace(s, "(?s) in .*$", ""))
    long = lambda s: F.when(F.octet_length(s) >= 2, s)
    strong = [long(F.regexp_replace(tail(after(line, c, False, ".,;0-9")), r"^[^\p{L} '-]+|[^\p{L} '-]+$", "")) for c in MOTION_CUES]
    return F.coalesce(*strong, *[long(tail(after(line, c, False, ".,;0-9"))) for c in MOTION_WORDS])


def _ruled(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    low = F.lower("line")
    found = first_rule(rules, lambda p: has_any(low, p), lambda r: F.struct(F.lit(r[1]).alias("event_type"), F.lit(r[2]).alias("predicate")))
    return rows.withColumn("_r", found).filter("_r is not null").select("*", "_r.event_type", "_r.predicate").drop("_r")


def travel(rows: DataFrame) -> DataFrame:
    return _ruled(rows, TRAVEL).withColumns({"year": first_year(F.col("line")), "place": travel_place(F.col("line"))})


def itinerary(rows: DataFrame) -> DataFrame:
    """Only lines with a plausible place and a year."""
    out = _ruled(rows, ITINERARY).withColumns({"year": first_year(F.col("line")), "place": motion_place(F.col("line"))})
    return out.filter(F.col("year").isNotNull() & F.coalesce(plausible(F.col("place")), F.lit(False)))


def publication(rows: DataFrame) -> DataFrame:
    """Only lines with a year."""
    out = rows.filter(has_any(F.lower("line"), PUBLICATION)).withColumns({"event_type": F.lit("publication"), "predicate": F.lit("published"), "year": first_year(F.col("line"))})
    return out.filter("year is not null").withColumn("place", travel_place(F.col("line")))


def posthumous(rows: DataFrame) -> DataFrame:
    """Commemorations after the subject's death."""
    out = rows.filter(has_any(F.lower("line"), COMMEMORATION)).withColumns({"event_type": F.lit("commemoration"), "predicate": F.lit("commemorated_at"), "year": first_year(F.col("line"))})
    place = F.coalesce(*[after(F.col("line"), c, True, ".0-9,") for c in (" in ", " at ", " to ")])
    return out.filter("year > death_year").withColumn("place", place)


def military(rows: DataFrame) -> DataFrame:
    """Only lines with a year up to two years after death and a plausible place. A campaign counts where it begins or opens."""
    line, low = F.col("line"), F.lower("line")
    phrase = [after(line, c, False, ".,;0-9") for c in ("battle of ", "siege of ")]
    near = [F.when(p.rlike(r"^\p{Lu}"), p) for p in (after(line, c, False, ".,0-9") for c in (" near ", " at ", " in "))]
    kind = lambda e, p: F.struct(F.lit(e).alias("event_type"), F.lit(p).alias("predicate"))
    found = first_rule(MILITARY, lambda p: has_any(low, p), lambda r: kind(r[1], r[2]))
    begun = F.when(F.contains(low, F.lit("campaign")) & has_any(low, CAMPAIGN_BEGINS), kind("military_campaign", "campaign_at"))
    out = rows.withColumn("_r", F.coalesce(found, begun)).filter("_r is not null").select("*", "_r.event_type", "_r.predicate").drop("_r")
    out = out.withColumns({"year": first_year(line), "place": F.coalesce(*phrase, *near)})
    return out.filter((F.col("year") <= F.coalesce(F.col("death_year") + 2, F.lit(2100))) & F.coalesce(plausible(F.col("place")), F.lit(False)))


def year_in_life(text: Column, birth: Column, death: Column, now: int) -> Column:
    """The first year of a text within a life, as a number."""
    window = time.life_window(birth, death, now)
    return time.parse_year(time.first_year(text, window["first"], window["last"]))


def campaign_titles(pages: DataFrame, now: int = 2100) -> DataFrame:
    """pages (page, title, text, death_year, ...) whose title is of a battle, siege, campaign or treaty, with event_type, predicate,
    year (the first of the text up to five years after death; null without one) and place (none for campaigns): one row from the title."""
    title = F.trim("title")
    low = F.lower(title)
    named = F.regexp_replace(F.trim(F.substring_index(F.regexp_replace(title, "(?i)^(battle|siege) of ", ""), "(", 1)), "[.,]+$", "")
    treaty = F.substring(title, F.instr(title, " of ") + 4, F.length(title))
    row = lambda e, p, place: F.struct(F.lit(e).alias("event_type"), F.lit(p).alias("predicate"), place.alias("place"))
    found = (
        F.when(F.startswith(low, F.lit("battle of ")), row("battle", "fought_at", named))
        .when(F.startswith(low, F.lit("siege of ")), row("siege", "besieged", named))
        .when(F.contains(low, F.lit("campaign")), row("military_campaign", "campaign_at", F.lit(None).cast("string")))
        .when(low.rlike("^treat(y|ies) of "), row("treaty", "signed", treaty))
    )
    out = pages.withColumn("_r", found).filter("_r is not null")
    year = year_in_life(F.col("text"), F.lit(None).cast("int"), F.col("death_year"), now)
    return out.select("page", "title", "_r.event_type", "_r.predicate", year.alias("year"), F.nullif("_r.place", F.lit("")).alias("place"))


def page_fallback(pages: DataFrame, found: DataFrame, now: int = 2100) -> DataFrame:
    """For pages (page, title, text, birth_year, death_year) without a row in found: one from a title in any of the known forms, if the text has a year in the life."""
    year = year_in_life(F.col("text"), F.col("birth_year"), F.col("death_year"), now)
    kind = title_event_type(F.trim("title"))
    predicate = F.when(kind == "treaty", "signed").when(kind == "siege", "besieged").otherwise("fought_at")
    rows = pages.join(found.select("page").distinct(), "page", "left_anti")
    rows = rows.select("page", "title", kind.alias("event_type"), predicate.alias("predicate"), year.alias("year"), from_title(F.col("title")).alias("place"))
    return rows.filter("place is not null and year is not null")


def timeline(rows: DataFrame) -> DataFrame:
    """``year — place — description`` lines; years may be BC; those after death are commemorations."""
    raw = F.regexp_replace(F.trim("line"), r"^[*•\s-]+", "")
    parts = F.transform(F.split(raw, "—"), lambda p: F.trim(p))
    rows = rows.withColumn("_p", parts).filter("size(_p) >= 2")
    first = F.col("_p")[0]
    bc = F.lower(first).rlike("bc|b[.]c|av")
    digits = F.nullif(F.regexp_replace(first, "[^0-9]", ""), F.lit("")).try_cast("int")
    year = F.when(bc, -digits).when(first.rlike("^-?[0-9]+$"), first.try_cast("int"))
    low = F.lower(F.coalesce(F.try_element_at("_p", F.lit(3)), F.lit("")))
    kind = lambda v, other: F.coalesce(first_rule(TIMELINE, lambda p: has_any(low, p), v), F.lit(other))
    rows = rows.withColumns({"year": year, "place": F.col("_p")[1], "predicate": kind(2, "occurred_at"), "_k": kind(1, "life_event")}).filter("year is not null")
    return rows.withColumn("event_type", F.when(F.col("year") > F.col("death_year"), "commemoration").otherwise(F.col("_k"))).drop("_p", "_k")


EXTRACTORS = {"travel": travel, "itinerary": itinerary, "publication": publication, "posthumous": posthumous, "military": military, "timeline": timeline}


def extract(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Candidates of all extractors, one row each, with the extractor's name."""
    rows = lines(pages)
    out = [EXTRACTORS[n](rows).select("page", "line_no", "line", "event_type", "predicate", "year", "place", F.lit(n).alias("extractor")) for n in names or EXTRACTORS]
    return reduce(DataFrame.unionByName, out)
