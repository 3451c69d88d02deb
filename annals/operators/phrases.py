"""Phrase tuples: several (person, time, place, verb) a sentence, by layouts after cues and by dense prose, with years and places carried on within batches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import first_alone, has_alone, has_any
from annals.functions.place import LOWER, UPPER, gazetteer, standing_alone, title_case
from annals.functions.text import let
from annals.functions.time import last_year
from annals.operators.mine import year_surface

TUPLE = "struct<person: string, time: string, place: string, verb: string>"


def constant(rows: list[dict], schema: str) -> Column:
    """A table of fixed values as one array."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def ordered_places() -> list[tuple[str, str]]:
    """(name, title) of the places that are looked for, the longest first (in bytes), then in list order. The list is a parameter of ``extract_phrases``."""
    return [(g[0], title_case(g[0])) for g in sorted(gazetteer(), key=lambda g: -len(g[0].encode()))]


def listed_place(low: Column, places: list[tuple[str, str]]) -> Column:
    """The title of the first place, in list order, whose first occurrence in ``low`` stands alone."""
    if not places:
        return F.lit(None).cast("string")
    rows: dict[str, dict] = {}
    for i, (name, title) in enumerate(places):
        rows.setdefault(name, {"place": i, "title": title})
    table = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "map<string, struct<place: int, title: string>>")

    def first(text: Column) -> Column:
        # the names that stand alone somewhere, found by pattern: few, whose first occurrence is then looked at
        found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in standing_alone(tuple(rows))]))
        return F.array_min(F.transform(F.filter(found, lambda n: first_alone(text, n)), lambda n: F.try_element_at(table, n)))["title"]

    return let(low, first)


def person_named(low: Column) -> Column:
    """struct(person, first, last) of the first alias, in list order, whose first occurrence stands alone."""
    table = [{"alias": a, "person": p, "first": y, "last": z} for p, aliases, y, z in rules.PHRASE_PERSONS for a in aliases]
    found = F.filter(constant(table, "alias: string, person: string, first: int, last: int"), lambda x: first_alone(low, x["alias"]))
    return F.try_element_at(F.transform(found, lambda x: F.struct(x["person"].alias("person"), x["first"].alias("first"), x["last"].alias("last"))), F.lit(1))


def page_person(page: Column) -> Column:
    """The same of the first subject that the page's title, in lower case, has a part of."""
    years = {p: (y, z) for p, _, y, z in rules.PHRASE_PERSONS}
    table = [{"part": x, "person": p, "first": years[p][0], "last": years[p][1]} for p, parts in rules.PHRASE_PAGES for x in parts]
    found = F.filter(constant(table, "part: string, person: string, first: int, last: int"), lambda x: F.contains(page, x["part"]))
    return F.try_element_at(F.transform(found, lambda x: F.struct(x["person"].alias("person"), x["first"].alias("first"), x["last"].alias("last"))), F.lit(1))


def page_place(page: Column, places: list[tuple[str, str]]) -> Column:
    """The place of a page: what a battle, treaty, congress, coup or siege of its title is of, or the listed place that the title is, or starts with if that has eight bytes."""
    title = F.trim(page)
    event = F.trim(F.substring_index(F.regexp_extract(title, f"^(?:{'|'.join(rules.PLACE_TITLES)})(.*)$", 1), "(", 1))
    bare = F.lower(F.trim(F.substring_index(title, "(", 1)))
    whole = lambda hit: (bare == F.lower(hit)) | (F.startswith(bare, F.lower(hit)) & (F.octet_length(hit) >= 8))
    return F.when(F.octet_length(event) >= 2, event).otherwise(let(listed_place(bare, places), lambda hit: F.when(whole(hit), hit)))


def last_four_digits(text: Column) -> Column:
    """The last run of exactly four digits from 1000 to 2100, as it is written."""
    runs = F.filter(F.split(text, "[^0-9]"), lambda r: (F.length(r) == 4) & r.between("1000", "2100"))
    return F.try_element_at(runs, F.lit(-1))


def trimmed_place(surface: Column) -> Column:
    return let(F.trim(F.regexp_replace(F.trim(surface), "[.,;)]+$", "")), lambda s: F.when((F.length(s) >= 2) & ~s.rlike("^[0-9]*$"), s))


def clean(place: Column) -> Column:
    s = F.trim(place)
    return F.length(s).between(2, 40) & ~has_any(F.lower(s), rules.PHRASE_NO_PLACE)


def layout_place_year(after: Column) -> Column:
    at = r"(?is)^(.*) in (.*)$"
    return F.struct(last_four_digits(F.regexp_extract(after, at, 2)).alias("time"), trimmed_place(F.nullif(F.regexp_extract(after, at, 1), F.lit(""))).alias("place"))


def parted(after: Column, kind: Column) -> Column:
    """struct(time, place) of what follows a cue, by its layout."""
    cut = lambda s, n: F.struct(last_four_digits(F.substring(s, F.lit(1), n - 1)).alias("time"), trimmed_place(F.substring(s, n + 4, F.length(s))).alias("place"))
    plain = F.instr(after, F.lit(" in "))
    first = F.instr(F.lower(after), F.lit(" in "))
    rest = F.substring(after, first + 4, F.length(after))
    by_second = lambda r: let(F.instr(F.lower(r), F.lit(" in ")), lambda n: F.when(n > 0, cut(r, n)).otherwise(layout_place_year(after)))
    return (
        F.when(kind == "year in place", F.when(plain > 0, cut(after, plain)))
        .when(kind == "place in year", layout_place_year(after))
        .when(first > 0, let(rest, by_second))
    )


def structured(text: Column, low: Column) -> Column:
    """The tuple of each layout whose cue the text has, in order."""
    table = constant([{"cue": c, "verb": v, "kind": k} for c, v, k in rules.PHRASE_LAYOUTS], "cue: string, verb: string, kind: string")

    def person_before(before: Column) -> Column:
        of, stop = (F.regexp_extract(before, p, 1) for p in (r"(?is)^.* of (.*)$", r"(?s)^.*\. (.*)$"))
        name = F.trim(F.when(before.rlike("(?is) of "), of).when(before.rlike(r"(?s)\. "), stop).otherwise(before))
        name = let(F.regexp_replace(name, "^[\"']+|[\"']+$", ""), lambda n: F.when(F.length(n) >= 3, n))
        return F.coalesce(let(F.lower(before), person_named)["person"], name, person_named(low)["person"])

    def one(x: Column) -> Column:
        # each step once, and a person only of what has a time and a place
        at = F.instr(low, x["cue"])
        before = F.trim(F.substring(text, F.lit(1), at - 1))
        found = parted(F.trim(F.substring(text, at + F.length(x["cue"]), F.length(text))), x["kind"])
        told = lambda person, f: F.when(person.isNotNull(), F.struct(person.alias("person"), f["time"].alias("time"), f["place"].alias("place"), x["verb"].alias("verb")).cast(TUPLE))
        return let(found, lambda f: F.when(f["time"].isNotNull() & clean(f["place"]), let(let(before, person_before), lambda person: told(person, f))))

    return F.filter(F.transform(F.filter(table, lambda x: F.contains(low, x["cue"])), one), lambda t: t.isNotNull())


def verb_of(low: Column, page: Column) -> Column:
    table = constant([{"cues": c, "verb": v} for v, c in rules.PHRASE_VERBS], "cues: array<string>, verb: string")
    cued = F.try_element_at(F.filter(table, lambda x: F.exists(x["cues"], lambda c: F.contains(low, c))), F.lit(1))["verb"]
    of_page = F.when(F.startswith(page, F.lit("battle of ")), "fought").when(F.startswith(page, F.lit("treaty of ")) | F.contains(page, F.lit("concordat")), "signed")
    return F.coalesce(cued, of_page.when(F.startswith(page, F.lit("congress of ")), "met"))


def unique(tuples: Column) -> Column:
    """Each verb, time and place (A-Z in any case) once, the first."""
    same = lambda a, b: a["verb"].eqNullSafe(b["verb"]) & (a["time"] == b["time"]) & (F.translate(a["place"], UPPER, LOWER) == F.translate(b["place"], UPPER, LOWER))
    start = F.expr(f"cast(array() as array<{TUPLE}>)")
    return F.aggregate(tuples, start, lambda seen, t: F.when(F.exists(seen, lambda s: same(s, t)), seen).otherwise(F.concat(seen, F.array(t))))


def extract_phrases(rows: DataFrame, text: str, page: str, batch: str, order: str, places: list[tuple[str, str]] | None = None) -> DataFrame:
    """rows with ordinal, person, time, place, verb: one row for each tuple of a sentence.

    Layouts come first, then at most one tuple from dense prose: a subject named in the text or by the
    page, the last year of the subject's lifetime, a place and the first verb's cue. What it lacks of
    year and place is carried on from the sentences before of the same page, but only where the
    sentence names a subject or says he, she or they; the carry ends where the page changes and with
    the batch, a column of the rows, whose few sentences (some 32) are one window.
    """
    places = ordered_places() if places is None else places
    # the window's own exchange comes before the work on the texts; by number, as it is work and not size that is dealt out
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), batch)
    c = F.col
    said = F.trim(F.regexp_replace(F.coalesce(c(text), F.lit("")), "'{2,3}", ""))
    rows = rows.withColumns({"_text": said, "_title": F.trim(F.coalesce(c(page), F.lit("")))}).withColumns({"_low": F.lower("_text"), "_page": F.lower("_title")})
    rows = rows.withColumn("_named", person_named(c("_low"))).withColumn("_who", F.coalesce("_named", page_person(c("_page"))))
    rows = rows.withColumns(
        {
            "_year": F.when(c("_who").isNotNull(), last_year(c("_low"), c("_who.first"), c("_who.last"))),
            "_place": F.coalesce(listed_place(c("_low"), places), page_place(c("_title"), places)),
        }
    )
    in_batch = Window.partitionBy(batch).orderBy(order)
    turned = F.coalesce(F.col(page), F.lit("")) != F.coalesce(F.lag(F.coalesce(F.col(page), F.lit(""))).over(in_batch), F.lit(""))
    rows = rows.withColumn("_turn", turned.cast("int")).withColumn("_run", F.sum("_turn").over(in_batch))
    before = Window.partitionBy(batch, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gives = c("_who").isNotNull() & ~has_any(c("_low"), rules.PHRASE_MEMORY)
    last = lambda x: F.last(F.when(gives, c(x)), ignorenulls=True).over(before)
    rows = rows.withColumns({"_old_year": last("_year"), "_old_place": last("_place")})
    year = F.coalesce("_year", F.when(c("_old_year").between(c("_who.first"), c("_who.last")), c("_old_year")))
    place = F.coalesce("_place", "_old_place")
    hook = c("_named").isNotNull() | has_alone(c("_low"), rules.PRONOUNS)
    rows = rows.withColumn("_verb", verb_of(c("_low"), c("_page")))
    verb = c("_verb")
    whole = c("_who").isNotNull() & year.isNotNull() & clean(place) & verb.isNotNull() & ((c("_year").isNotNull() & c("_place").isNotNull()) | hook)
    dense = F.when(whole, F.struct(c("_who.person").alias("person"), year_surface(year).alias("time"), place.alias("place"), verb.alias("verb")).cast(TUPLE))
    tuples = unique(F.concat(structured(c("_text"), c("_low")), F.array_compact(F.array(dense))))
    own = [x for x in rows.columns if not x.startswith("_")]
    return rows.select(*own, F.posexplode(tuples).alias("ordinal", "_tuple")).select(*own, "ordinal", *[F.col("_tuple")[k].alias(k) for k in ("person", "time", "place", "verb")])
