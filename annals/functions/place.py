"""Place labels and the gazetteer, a rule table of bounded size that travels as one constant."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import either, first_alone
from annals.functions.text import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(name: str) -> str:
    """Without accents, long dashes as hyphens."""
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).replace("–", "-")


@cache
def gazetteer() -> list[tuple[str, float, float, int]]:
    """(name, latitude, longitude, 1 for a locality) of all names, in order, with and without accents."""
    rows = [(n, lat, lon, 1) for names, lat, lon in rules.GAZETTEER for n in names.split("|")] + [(*r, 0) for r in rules.REALMS]
    both = [(n, *r[1:]) for r in rows for n in (r[0], plain(r[0]))]
    return list({r[0]: r for r in reversed(both)}.values())[::-1]


def clean_label(surface: Column) -> Column:
    return F.regexp_replace(F.trim(surface), r"\.+$", "")


def coordinates(label: Column) -> Column:
    """struct(lat, lon) of an exact gazetteer name; null without one."""
    table = json.dumps({n: {"lat": lat, "lon": lon} for n, lat, lon, _ in gazetteer()}, ensure_ascii=False)
    return F.try_element_at(F.from_json(F.lit(table), "map<string, struct<lat: double, lon: double>>"), F.lower(label))


def title_case(name: str) -> str:
    """Parts between blanks and hyphens with a capital; hyphens between all if there is one."""
    return ("-" if "-" in name else " ").join(p[:1].upper() + p[1:] for p in name.replace("-", " ").split(" "))


@cache
def standing_alone(names: tuple[str, ...]) -> list[str]:
    """Patterns that together find every name that stands alone, wherever it does: of the names that start at a place a pattern finds one, so names that start with another are in a later one."""
    level: dict[str, int] = {}
    for n in sorted(names, key=len):
        level[n] = 1 + max((level[m] for m in level if n.startswith(m)), default=-1)
    layers = [[n for n in names if level[n] == k] for k in range(max(level.values()) + 1)]
    return [f"(?<![a-z0-9])(?=({either(layer)})(?![a-z0-9]))" for layer in layers]


def best_in_text(text: Column, value: str = "name") -> Column:
    """The best gazetteer name whose first occurrence in text stands alone: localities before realms, then the longest (in bytes), then list order.

    value: ``name``, or ``title`` for the name in title case. Only A-Z are lower-cased.
    """
    rows = {n: {"locality": loc, "size": len(n.encode()), "place": -i, "name": n, "title": title_case(n)} for i, (n, _, _, loc) in enumerate(gazetteer())}
    table = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "map<string, struct<locality: int, size: int, place: int, name: string, title: string>>")

    def best(low: Column) -> Column:
        # the names that stand alone somewhere, found by pattern: few, whose first occurrence is then looked at
        found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in standing_alone(tuple(rows))]))
        return F.array_max(F.transform(F.filter(found, lambda n: first_alone(low, n)), lambda n: F.try_element_at(table, n)))[value]

    return let(F.translate(text, UPPER, LOWER), best)


def of_page(title: Column) -> Column:
    """The place that a page is about: what its title says a battle, treaty, congress, siege or coup of, or the gazetteer name that
    the title without brackets is, or starts with if the name has eight bytes or more."""
    title = F.trim(title)
    event = F.trim(F.substring_index(F.regexp_extract(title, f"^(?:{'|'.join(rules.PLACE_TITLES)})(.*)$", 1), "(", 1))
    bare = F.trim(F.substring_index(title, "(", 1))
    hit, low = best_in_text(bare, "title"), F.translate(bare, UPPER, LOWER)
    name = F.translate(hit, UPPER, LOWER)
    whole = (low == name) | (F.startswith(low, name) & (F.octet_length(hit) >= 8))
    return F.when(F.octet_length(event) >= 2, event).when(whole, hit)


MONTHS = "january february march april may june july august september october november december".split()


def plausible(label: Column) -> Column:
    """Whether a surface looks like a place and not like a piece of a sentence."""
    s = F.trim(label)
    low = F.lower(s)
    size = F.octet_length(s)
    bad = [
        ~size.between(2, 60), F.contains(s, F.lit("\n")), F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) > 5,
        F.contains(low, F.lit(" the ")), low.rlike("^(the |a |an |his |her |their |have |fight|chapter)"), F.contains(low, F.lit("coalition")), F.contains(low, F.lit("claim")),
        low.isin(MONTHS), ~s.rlike(r"^\p{L}"), F.contains(s, F.lit(" ")) & ~s.rlike(r"\p{Lu}"), low.rlike(r"( on| in| at| of| the|\(|-)$"),
    ]
    out = F.lit(True)
    for b in bad:
        out = out & ~F.coalesce(b, F.lit(True))
    return out


SEPARATORS = ["–", "-", "/", ","]
TITLE_STARTS = "battle of |siege of |treaty of |treaties of |bataille de |siège de |traite de |traité de "


def resolve_alias(label: Column) -> Column:
    """struct(alias, lat, lon, precision) of a label: of itself, without a qualifier in brackets, or of the left or right part of a compound; null for unknown ones."""
    table = json.dumps({n: {"alias": n, "lat": lat, "lon": lon, "precision": p} for n, lat, lon, p in rules.ALIASES}, ensure_ascii=False)
    names = F.from_json(F.lit(table), "map<string, struct<alias: string, lat: double, lon: double, precision: string>>")

    def found(key: Column) -> Column:
        known = lambda c: F.try_element_at(names, c)
        tries = [known(key), known(F.trim(F.substring_index(key, "(", 1)))]
        for s in SEPARATORS:
            has = F.contains(key, F.lit(s))
            right = F.trim(F.substring(key, F.instr(key, s) + 1, F.length(key)))
            tries += [F.when(has, known(F.trim(F.substring_index(key, s, 1)))), F.when(has, known(right))]
        return F.coalesce(*tries)

    return let(F.lower(F.trim(label)), found)


def from_title(title: Column) -> Column:
    """The place of a title like "Battle of X (1805)"; null for others."""
    found = F.trim(F.substring_index(F.regexp_extract(title, f"(?i)^(?:{TITLE_STARTS})(.*)$", 1), "(", 1))
    return F.when(found != "", found)
