"""Judges: a verdict for each candidate (who, did what, where, when), its category and how sure it is; kinds of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals import rules
from annals.functions.classify import first_rule, has_alone, has_any, has_word
from annals.functions.place import clean_label, coordinates
from annals.functions.text import let
from annals.functions.time import parse_year


#: What the rules of ``category`` say, in the order in which they are tried: (event type, label, family).
CATEGORIES = [
    ("anecdote", "anecdote", "anecdote"),
    *[(r[1], r[2], "legacy") for r in rules.COMMEMORATIVE],
    ("life_event", "grieved", "bio"),
    *[r[1:] for r in rules.VERBS],
    *[r[1:] for r in rules.SENTENCE_CUES],
]


def others_death(verb: Column, sentence: Column, person: Column) -> Column:
    """Whether a death that the verb or sentence tells of is not the person's: somebody's relative died, or "'s death" is said, and
    neither the person's name nor its last word (of three bytes or more) dies. All in lower case."""
    last = F.regexp_extract(person, r"(\S+)$", 1)
    said = lambda a: has(sentence, a, " died") | has(sentence, a, " drowned") | F.contains(sentence, F.concat(F.lit("death of "), a)) | has(sentence, a, "'s death")
    has = lambda text, a, tail: F.contains(text, F.concat(a, F.lit(tail)))
    own = said(person) | ((F.octet_length(last) >= 3) & said(last))
    told = has_word(verb, ["died", "death"]) | has_any(sentence, ["drowned", " died", "'s death"])
    other = has_any(sentence, ["'s death"]) | (has_any(sentence, rules.DEATH_CUES) & has_alone(sentence, rules.RELATIVES))
    return F.coalesce(told & other & ~own, F.lit(False))


def category(verb: Column, sentence: Column, person: Column) -> Column:
    """The place in CATEGORIES: anecdotes, commemorations, another's death, the verb, cues of the sentence; -1 for none of them.

    A number and no struct, so that the tests of a row run once, whatever is read from it. All in lower case.
    """
    tests = [verb.isin("anecdoted", "anecdote") | has_any(sentence, rules.ANECDOTE_CUES)]
    tests += [has_any(sentence, r[0]) for r in rules.COMMEMORATIVE]
    tests += [others_death(verb, sentence, person)]
    tests += [has_word(verb, r[0]) for r in rules.VERBS]
    tests += [has_any(sentence, r[0]) for r in rules.SENTENCE_CUES]
    out = F.when(tests[0], 0)
    for i, test in enumerate(tests[1:], 1):
        out = out.when(test, i)
    return out.otherwise(-1)


def epistemic_status(low: Column, family: Column) -> Column:
    """How sure a sentence in lower case is."""
    return (
        F.when(has_any(low, rules.RUMOR), "rumor")
        .when(has_any(low, rules.THEORY), "theory")
        .when(family == "anecdote", "attested")
        .when(has_any(low, rules.UNCERTAIN), "uncertain")
        .when(family.isin("bio", "work"), "established")
        .otherwise("attested")
    )


def judge(candidates: DataFrame) -> DataFrame:
    """Adds to candidates (person, verb, time_surface, place_surface, sentence): year, event_type, verb_label, family,
    status, score (hundredths), verdict, place_label, lat, lon, map_eligible, title.

    A missing time or place (score 10) or a time without a year (20) is rejected. The others start from 75 and lose
    8 at most, so they all reach the 55 that acceptance takes: the verdict needs none of the rules.
    """
    missing = (F.trim(F.coalesce("time_surface", F.lit(""))) == "") | (F.trim(F.coalesce("place_surface", F.lit(""))) == "")
    c = candidates.withColumns({"year": parse_year(F.col("time_surface")), "place_label": clean_label(F.col("place_surface")), "_missing": missing})
    c = c.withColumns({"verdict": F.when(F.col("_missing") | F.col("year").isNull(), "reject").otherwise("accept"), "_at": coordinates(F.col("place_label"))})
    # columns of their own, so that they are made once and not for each rule
    c = c.withColumns({"_v": F.lower(F.trim(F.coalesce("verb", F.lit("")))), "_s": F.lower("sentence"), "_p": F.lower(F.trim("person"))})
    c = c.withColumn("_rule", category(F.col("_v"), F.col("_s"), F.col("_p")))
    of = lambda k: F.try_element_at(F.array(*[F.lit(x[k]) for x in CATEGORIES]), F.col("_rule") + 1)
    verb = F.col("_v")
    named = F.when(F.col("_rule") >= 0, of(1)).when(verb == "", "associated").otherwise(verb)
    c = c.withColumns({"_type": F.when(F.col("_rule") >= 0, of(0)).otherwise("life_event"), "verb_label": named, "family": F.when(F.col("_rule") >= 0, of(2)).otherwise("other")})
    c = c.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon"), "_status": epistemic_status(F.col("_s"), F.col("family"))})
    yes, status = F.col("verdict") == "accept", F.col("_status")
    points = (
        F.lit(35 + 25 + 15)
        + F.when(F.col("lat").isNotNull(), 10).otherwise(0)
        + F.when(F.col("family") != "other", 15).when(verb != "", 8).otherwise(0)
        + F.when(F.octet_length(F.trim("person")) >= 3, 5).otherwise(0)
    )
    less = F.when(status.isin("rumor", "theory"), -5).when(status == "uncertain", -8).when(status == "established", 5).otherwise(0)
    score = F.when(F.col("_missing"), 10).when(F.col("year").isNull(), 20).otherwise(F.least(points + less, F.lit(100)))
    title = F.concat(F.trim("person"), F.lit(" "), F.col("verb_label"), F.lit(" in "), F.col("place_label"), F.lit(" ("), F.regexp_replace(F.trim("time_surface"), r"\.+$", ""), F.lit(")"))
    return c.withColumns(
        {
            "score": score.cast("int"),
            "event_type": F.when(yes, F.col("_type")).otherwise("life_event"),
            "status": F.when(yes, status).otherwise("uncertain"),
            "map_eligible": yes & F.col("lat").isNotNull(),
            "title": F.when(yes, title).otherwise(F.col("person")),
        }
    ).drop("_missing", "_at", "_rule", "_type", "_status", "_v", "_s", "_p")


def claim_class(text: Column, value: int) -> Column:
    """Kind (1), epistemic status (2), relation (3) or confidence in hundredths (4) of a claim's text."""
    low = F.lower(text)
    life = has_any(low, rules.LIFE_VERBS) & low.rlike("[0-9]") & (low.rlike("[12]") | low.rlike("(^|[^0-9])[0-9]{4}([^0-9]|$)"))
    rest = {1: ("life_event", "context", "fact"), 2: ("attested",) * 3, 3: ("direct", "indirect", "direct"), 4: (65, 45, 40)}[value]
    return F.coalesce(
        first_rule(rules.CLAIM_KINDS, lambda p: has_any(low, p), value),
        F.when(life, F.lit(rest[0])).when(has_any(low, rules.CONTEXT_CUES), F.lit(rest[1])).otherwise(F.lit(rest[2])),
    )


def predicate_of(clause: Column, value: int) -> Column:
    """Event type (1) or predicate (2) of a clause; null without a cue."""
    return let(F.lower(clause), lambda low: first_rule(rules.PREDICATES, lambda p: has_any(low, p), value))


def person_score(description: Column) -> Column:
    """50 for words of persons, -70 for things, -35 for places and works."""
    low = F.lower(F.coalesce(description, F.lit("")))
    person = has_word(low, rules.PERSON_WORDS) | has_any(low, rules.PERSON_PARTS)
    return F.when(person, 50).otherwise(0) - F.when(has_any(low, rules.THING_PARTS), 70).otherwise(0) - F.when(has_any(low, rules.PLACE_PARTS), 35).otherwise(0)


def resume_action(status: Column) -> Column:
    """What a retry does with a candidate it has met: finished ones are skipped, accepted ones only assembled, others judged again."""
    return F.when(status.isin("assembled", "rejected"), "skip").when(status == "accepted", "assemble").otherwise("gates")


def title_event_type(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("^(siege|siège)"), "siege").when(low.rlike("^(treaty|traité)"), "treaty").otherwise("battle")
