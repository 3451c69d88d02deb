"""Keys and fingerprints: SHA-256 over parts in a fixed order; and normal forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annals.functions.text import normalize_surface


def joined_hash(*parts: Column) -> Column:
    """Parts with bars between; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def barred_hash(*parts: Column) -> Column:
    """Parts with a bar after each; null counts as empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("|"))]), 256)


def combinator_hash(sentence: Column, person: Column, time: Column, place: Column, verb: Column) -> Column:
    return joined_hash(sentence, person, time, place, verb)


def candidate_fingerprint(
    version: Column, subject: Column, event_type: Column, predicate: Column, time_key: Column, place: Column, snapshot: Column, clause: Column, start: Column, end: Column, participants: Column
) -> Column:
    """participants: array of keys, in any order."""
    names = F.array_join(F.array_sort(participants), ",")
    return joined_hash(version, normalize_surface(subject), event_type, predicate, time_key, normalize_surface(place), snapshot, clause, start, end, names)


def event_fingerprint(subject: Column, event_type: Column, predicate: Column, time_key: Column, place: Column, participants: Column) -> Column:
    """Identity of an assembled event, so that assembling again adds nothing. participants: array of ids, in any order."""
    return joined_hash(F.lit("event"), subject, event_type, predicate, time_key, place, F.array_join(F.array_sort(participants), ","))


def occurrence_key(subject: Column, event_type: Column, role: Column, time_key: Column, place: Column, thing: Column) -> Column:
    """Identity of what happened, whoever reports it."""
    empty = F.lit("")
    return barred_hash(normalize_surface(subject), event_type, role, time_key, normalize_surface(place), normalize_surface(thing), empty, empty)


def occurrence_stem(subject: Column, event_type: Column, role: Column, time_key: Column, thing: Column) -> Column:
    """The same without the place: competing readings share it."""
    return occurrence_key(subject, event_type, role, time_key, F.lit(""), thing)


def claim_fingerprint(subject: Column, predicate: Column, value: Column, time_key: Column, place_key: Column) -> Column:
    return barred_hash(normalize_surface(subject), predicate, normalize_surface(value), time_key, normalize_surface(place_key))


def normalize_identifier(scheme: Column, raw: Column) -> Column:
    """The normal form by scheme (nnt, ppn, doi, isbn10, isbn13, num_sujet, others); null where nothing valid is left."""
    s = F.trim(raw)
    low = F.lower(s)
    compact, digits = F.upper(F.regexp_replace(s, "[^a-zA-Z0-9]", "")), F.regexp_replace(s, "[^0-9]", "")
    some = lambda c: F.when(c != "", c)
    form = (
        F.when(scheme == "nnt", some(compact))
        .when(scheme == "ppn", some(digits))
        .when(scheme == "doi", F.trim(F.regexp_replace(low, "^(https://doi[.]org/|http://doi[.]org/|doi:)", "")))
        .when(scheme.isin("isbn10", "isbn13"), F.when(F.length(compact).isin(10, 13), compact))
        .when(scheme == "num_sujet", F.when(F.startswith(low, F.lit("s")), low).otherwise(F.concat(F.lit("s"), low)))
        .otherwise(low)
    )
    return F.when(s != "", form)
