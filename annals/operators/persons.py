"""Classes of persons from their occupations, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals.functions.classify import first_rule, has_any

# The first list with a part of the text decides.
CLASSES = [
    (["physicist", "chemist", "scientist", "mathematician", "biologist", "physician", "physicien", "chimiste", "scientifique", "computer scientist", "cryptanalyst", "nobel"], "scientist"),
    (["inventor", "engineer", "inventeur", "ingénieur", "ingenieur"], "inventor_engineer"),
    (["writer", "poet", "novelist", "author", "écrivain", "ecrivain", "poète", "poete", "romancier", "journalist"], "artist_writer"),
    (["painter", "sculptor", "architect", "peintre", "sculpteur", "architecte"], "artist_visual"),
    (["composer", "musician", "compositeur", "musicien"], "musician_composer"),
    (["philosopher", "philosophe", "thinker", "penseur"], "philosopher"),
    (["explorer", "navigator", "voyageur", "explorateur", "navigateur"], "explorer"),
    (["pharaoh", "queen of", "king of", "emperor", "empress", "monarch", "president", "prime minister", "pharaon", "reine", "roi", "empereur"], "ruler"),
    (["military", "soldier", "general", "admiral", "officer", "maréchal", "marechal", "militaire"], "military_leader"),
    (["saint", "pope", "cardinal", "theologian", "religieux"], "religious_leader"),
    (["athlete", "sportsman", "footballer", "champion"], "athlete"),
    (["revolutionary", "reformer", "révolutionnaire", "reformateur"], "reformer"),
    (["statesman", "politician", "homme d'état"], "ruler"),
]
ORDER = [
    "scientist", "inventor_engineer", "artist_writer", "artist_visual", "musician_composer", "philosopher", "explorer", "religious_leader", "athlete", "reformer",
    "military_leader", "ruler",
]
SERVICE = ["fought", "enlisted", "served in", "served as", "soldier", "battled", "combattit", "s'engagea", "s engager", "militaire"]
MILITARY_TYPES = ["battle", "siege", "military_campaign", "surrender", "retreat"]


def class_of(text: Column) -> Column:
    """The class of an occupation or a lead; null without one."""
    low = F.lower(text)
    return first_rule(CLASSES, lambda p: has_any(low, p), 1)


def person_classes(occupations: DataFrame) -> DataFrame:
    """occupations: person, occupation. One row per person: classes (in ORDER), primary (the first, else unknown), military."""
    found = occupations.groupBy("person").agg(F.collect_set(class_of(F.col("occupation"))).alias("_found"))
    classes = F.filter(F.array(*[F.lit(c) for c in ORDER]), lambda c: F.array_contains(F.col("_found"), c))
    found = found.select("person", classes.alias("classes"))
    return found.withColumns({"primary": F.coalesce(F.try_element_at("classes", F.lit(1)), F.lit("unknown")), "military": F.array_contains("classes", "military_leader")})


def keeps_military(event_type: Column, military: Column, clause: Column, subject: Column) -> Column:
    """Whether a candidate stays: battles and the like only of military persons, or where the clause tells of the subject's service."""
    low = F.lower(clause)
    words = F.filter(F.transform(F.split(F.lower(subject), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")), lambda w: F.length(w) >= 4)
    named = F.exists(words, lambda w: F.contains(low, w))
    return ~event_type.isin(MILITARY_TYPES) | military | (named & has_any(low, SERVICE))
