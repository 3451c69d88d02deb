"""Time surfaces. Years are ints (BC negative); no dates before our era are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year(surface: Column) -> Column:
    """The year of a time surface: up to 4 digits in all; 1000 to 2100, or 1 to 4000 with BC (negative); else null."""
    low, digits = F.lower(surface), F.regexp_replace(surface, "[^0-9]", "")
    n = F.when(F.length(digits).between(1, 4), digits.cast("int"))
    bc = F.contains(low, F.lit("bc")) | F.contains(low, F.lit("b.c"))
    return F.when(bc, F.when(n.between(1, 4000), -n)).when((F.length(digits) == 4) & n.between(1000, 2100), n)


def years(text: Column) -> Column:
    """All years of a text in order: runs of at most 4 digits; 1 to 4000 before BC (negative), else four digits from 1000 to 2100."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(r"([0-9]+\s*(?:b\.?c)?)"), 1)

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, "^([0-9]+)", 1)
        n = F.when(F.length(digits) <= 4, digits.cast("int"))
        bc = F.contains(x, F.lit("b"))
        return F.when(bc, F.when(n.between(1, 4000), -n)).when((F.length(digits) == 4) & n.between(1000, 2100), n)

    return F.filter(F.transform(found, one), lambda y: y.isNotNull())


def last_year(text: Column, low: Column, high: Column) -> Column:
    """The last year of text within low to high."""
    return F.try_element_at(F.filter(years(text), lambda y: (y >= low) & (y <= high)), F.lit(-1))


def typed_time(year: Column, surface: Column) -> Column:
    """struct(kind, year, month, day, start_year, end_year, surface)."""
    none = F.lit(None).cast("int")
    kind = F.when(year.isNotNull(), F.lit("exact")).otherwise(F.lit("unknown"))
    return F.struct(kind.alias("kind"), year.alias("year"), none.alias("month"), none.alias("day"), none.alias("start_year"), none.alias("end_year"), surface.alias("surface"))


def canonical_key(time: Column) -> Column:
    """exact:year:month:day with 0 for what isn't known, range:start:end, approx:year or unknown."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return (
        F.when(time["kind"] == "exact", F.concat_ws(":", F.lit("exact"), z(time["year"]), z(time["month"]), z(time["day"])))
        .when(time["kind"] == "range", F.concat_ws(":", F.lit("range"), z(time["start_year"]), z(time["end_year"])))
        .when(time["kind"] == "approx", F.concat_ws(":", F.lit("approx"), z(time["year"])))
        .otherwise("unknown")
    )


# Month names in the order in which they are tried.
MONTHS = [
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11), ("december", 12),
    ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("sept", 9), ("oct", 10), ("nov", 11), ("dec", 12),
]
DAY, YEAR = "0*([1-9]|[12][0-9]|3[01])", "(1[0-9]{3}|20[0-9]{2}|2100)"
ISO = f"{YEAR}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"


def month_pattern(name: str) -> str:
    """A day, the month as a word of its own, and a year. The order of MONTHS decides, not that of the text."""
    return f"(?:^|[^0-9]){DAY}(?:[^0-9]*[^a-z0-9])?{name}[, ]*{YEAR}"


def calendar_date(text: Column) -> Column:
    """struct(kind, year, month, day, start_year, end_year, surface) of a text: day, month and year, else an ISO date, else a
    year alone (four digits from 1, or with BC), else unknown."""
    low = F.lower(text)
    part = lambda pattern, i: F.nullif(F.regexp_extract(low, pattern, i), F.lit("")).cast("int")
    made = lambda y, m, d: F.struct(y.alias("year"), m.alias("month"), d.alias("day"))
    none = F.lit(None).cast("int")
    found = [F.when(low.rlike(month_pattern(n)), made(part(month_pattern(n), 2), F.lit(m), part(month_pattern(n), 1))) for n, m in MONTHS]
    found.append(F.when(low.rlike(ISO), made(part(ISO, 1), part(ISO, 2), part(ISO, 3))))
    bc = r"(?:^|[^0-9])([0-9]{1,4})\s*(?:b\.?c|av\.? j)"
    found.append(F.when(low.rlike(bc), made(-part(bc, 1), none, none)))
    year = F.try_element_at(F.filter(F.transform(F.filter(F.split(low, "[^0-9]"), lambda r: F.length(r) == 4), lambda r: r.cast("int")), lambda y: y.between(1, 2100)), F.lit(1))
    found.append(F.when(year.isNotNull(), made(year, none, none)))
    d = F.coalesce(*found)
    kind = F.when(d.isNotNull(), "exact").otherwise("unknown")
    return F.struct(kind.alias("kind"), d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), none.alias("start_year"), none.alias("end_year"), text.alias("surface"))


def time_surface(text: Column) -> Column:
    """The first time that a text names: day, month and year (in the order of MONTHS), an ISO date, a year before our era, a year; else null."""
    low = F.lower(text)
    dated = [F.when(low.rlike(month_pattern(n)), F.concat(F.regexp_extract(low, month_pattern(n), 1), F.lit(f" {n} "), F.regexp_extract(low, month_pattern(n), 2))) for n, _ in MONTHS]
    bc = r"(?:^|[^0-9])0*([0-9]{1,4})\s*(?:b\.?c|av\.? j)"
    four = F.filter(F.split(low, "[^0-9]"), lambda r: (F.length(r) == 4) & r.try_cast("int").between(1, 2100))
    return F.coalesce(
        *dated,
        F.nullif(F.regexp_extract(low, ISO, 0), F.lit("")),
        F.when(low.rlike(bc), F.concat(F.regexp_extract(low, bc, 1), F.lit(" BC"))),
        F.try_element_at(four, F.lit(1)).cast("int").cast("string"),
    )


def sort_key(time: Column) -> Column:
    """An int in the order of time; years alone stand in the middle of June. No dates before our era are made."""
    z = lambda c, other: F.coalesce(c, F.lit(other))
    return time["year"] * 10000 + z(time["month"], 6) * 100 + z(time["day"], 15)


def life_window(birth: Column, death: Column, now: int) -> Column:
    """struct(first, last): from two years before birth to five after death, a life of 120 years where one is unknown; else from 4000 BC to now. ``now`` is a parameter."""
    last = F.coalesce(death + 5, F.least(F.lit(now), birth + 120), F.lit(now))
    return F.struct(F.coalesce(birth - 2, death - 120, F.lit(-4000)).alias("first"), last.alias("last"))


def first_year(text: Column, low: Column, high: Column) -> Column:
    """The first year of a text within low to high, as it is written: years before our era come first (``44 BC``), then runs of exactly four digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![0-9])([0-9]{1,4}\s*(?:b\.?c|av\.? j))"), 1)
    before = F.transform(found, lambda x: F.regexp_extract(x, "^[0-9]+", 0).cast("int"))
    before = F.filter(before, lambda y: (-y >= low) & (-y <= high))
    plain = F.transform(F.filter(F.split(text, "[^0-9]"), lambda r: F.length(r) == 4), lambda r: r.cast("int"))
    plain = F.filter(plain, lambda y: (y >= low) & (y <= high))
    return F.coalesce(F.concat(F.try_element_at(before, F.lit(1)).cast("string"), F.lit(" BC")), F.try_element_at(plain, F.lit(1)).cast("string"))
