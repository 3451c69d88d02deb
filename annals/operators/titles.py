"""Page titles: which are noise, how they rank for a subject, and the merged list to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import has_any
from annals.functions.place import plausible

# Fixed values.
NOISE_STARTS = ["list of years", "list of decades", "list of centuries", "ad ", "bc ", "isbn", "doi", "category:", "template:", "file:", "wikipedia:", "help:", "portal:", "talk:"]
NOISE_ENDS = [" in literature", " in science", " in music", " in sports", " century", " millennium"]
NOISE_PARTS = ["disambiguation", "(identifier)"]
VALUE_STARTS = ["treaty of ", "treaties of ", "early life", "scientific career", "timeline of ", "list of awards"]
VALUE_PARTS = [
    "university", "université", "institute", "institut", "laboratory", "laboratoire", "college", "collège", "academy", "académie", "hospital", "hôpital", "nobel", "prize", "prix ",
    "radioactiv", "conservatoire", "polytechnic", "polytechnique", "sorbonne",
]


def starts(text: Column, parts: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in parts) + ")")


def ends(text: Column, parts: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(parts) + ")$")


def is_noise(title: Column) -> Column:
    """Titles of lists, categories, years and sentences."""
    t = F.trim(title)
    low, blanks = F.lower(t), F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return (
        ~F.octet_length(t).between(2, 80) | starts(low, NOISE_STARTS) | ends(low, NOISE_ENDS) | has_any(low, NOISE_PARTS) | (blanks > 6) | F.contains(t, F.lit(":"))
        | (F.contains(low, F.lit(" the ")) & (blanks > 3)) | t.rlike("^[0-9]{4}$")
    )


def rank(subject: Column, title: Column) -> Column:
    """0 for the subject's own page, 1 with the surname, 2 for pages of institutions and treaties, else 3."""
    low, words = F.lower(title), F.split(F.trim(subject), r"\s+")
    surname = F.lower(F.element_at(words, -1))
    named = (F.size(words) >= 2) & F.contains(low, surname)
    return F.when(low == F.lower(subject), 0).when(named, 1).when(starts(low, VALUE_STARTS) | has_any(low, VALUE_PARTS), 2).otherwise(3)


def merged_titles(titles: DataFrame, most: int) -> DataFrame:
    """titles: subject, title, seq. Of each subject the ``most`` best: noise out, one row for each title whatever its
    case (the first by seq), by rank and title."""
    rows = titles.withColumn("title", F.trim("title")).filter(~is_noise(F.col("title")))
    once = rows.groupBy("subject", F.lower("title").alias("_key")).agg(F.min_by("title", "seq").alias("title"))
    w = Window.partitionBy("subject").orderBy("rank", "title")
    ranked = once.withColumn("rank", rank(F.col("subject"), F.col("title"))).withColumn("place", F.row_number().over(w))
    return ranked.filter(F.col("place") <= most).select("subject", "title", "rank", "place")


#: Fixed values: (what a text says, how the title begins), in the order in which they are looked for.
LINKED = [
    ("battle of ", "Battle of "), ("siege of ", "Siege of "), ("treaty of ", "Treaty of "), ("bataille de ", "Bataille de "), ("siège de ", "Siège de "), ("traite de ", "Traité de "), ("traité de ", "Traité de "),
]
MOST_LINKED = 81


def linked_titles(text: Column) -> Column:
    """Titles of battles, sieges and treaties that a text names, English and French: the name goes up to a mark or bracket and has to be a
    plausible place of 2 to 60 bytes. By form, then in order of the text; no more than 81, as a page's links are followed."""

    def of(said: str, head: str) -> Column:
        names = F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu){said}(?=([^.,;\n()]*))"), 1), lambda n: F.trim(n))
        good = F.filter(names, lambda n: F.octet_length(n).between(2, 60) & F.coalesce(plausible(n), F.lit(False)))
        return F.transform(good, lambda n: F.concat(F.lit(head), n))

    return F.slice(F.concat(*[of(said, head) for said, head in LINKED]), 1, MOST_LINKED)


def title_rank(title: Column, classes: Column, death_year: Column, military: Column) -> Column:
    """How well a page's title goes with a person, in hundredths: the best of the person's classes (an array; none counts as unknown).

    40; 15 if a profile speaks against it, unless it is a battle and the person military; 40 more if the
    profile speaks for it, 30 for a military person's battle, 50 less for the wars after 1900 if the person died before.
    """
    low = F.lower(title)
    military = F.coalesce(military, F.lit(False)) & has_any(low, rules.BATTLE_TITLES)
    late = F.coalesce(death_year < 1900, F.lit(False)) & has_any(low, rules.LATE_WARS)
    given = F.when(F.size(F.coalesce(classes, F.array().cast("array<string>"))) == 0, F.array(F.lit("unknown"))).otherwise(classes)

    def score(speaks_for: list[str], against: list[str]) -> Column:
        points = F.lit(40) + F.when(has_any(low, speaks_for), 40).otherwise(0) + F.when(military, 30).otherwise(0) - F.when(late, 50).otherwise(0)
        return F.when(has_any(low, against) & ~military, 15).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points)))

    return F.array_max(F.array(F.lit(0), *[F.when(F.array_contains(given, c), score(plus, minus)) for c, _, plus, minus in rules.PROFILES]))


def keeps_title(title: Column, subject: Column, rank: Column) -> Column:
    """Whether a page is kept for its subject: from 55 hundredths on, or if it is the subject's own."""
    return (F.lower(title) == F.lower(subject)) | (rank >= 55)
