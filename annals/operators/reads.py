"""Reading queries: timelines with optional filters, fragments with and without judgments, sources of claims, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annals.functions.text import fold
from annals.operators.stage import disputes


def person_match(name: Column, pattern: str, aliases: Column | None = None) -> Column:
    """Whether the name has the pattern in any case, or without accents, or one of its aliases (an array) does."""
    wanted = fold(F.lit(pattern))
    hit = F.contains(F.lower(name), F.lower(F.lit(pattern))) | F.contains(fold(name), wanted)
    return hit if aliases is None else hit | F.coalesce(F.exists(aliases, lambda a: F.contains(fold(a), wanted)), F.lit(False))


def timeline(events: DataFrame, entities: DataFrame, profiles: DataFrame | None = None, *, entity=None, person: str | None = None, profile: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """events (entity_id, year, ...) of known entities (entity_id, name), with the name; filters that are None pass all.

    profiles: entity_id, slug. Events without a year pass the period. Entities are filtered before the join; the profile is a semi-join.
    """
    if entity is not None:
        entities = entities.filter(F.col("entity_id") == entity)
    if person is not None:
        entities = entities.filter(person_match(F.col("name"), person))
    if profile is not None:
        entities = entities.join(profiles.filter(F.col("slug") == profile), "entity_id", "left_semi")
    if first is not None or last is not None:
        low, high = -9999 if first is None else first, 9999 if last is None else last
        events = events.filter(F.col("year").isNull() | F.col("year").between(low, high))
    return events.join(entities.select("entity_id", "name"), "entity_id")


def apply_geocodes(events: DataFrame, geocodes: DataFrame) -> DataFrame:
    """events (place_label, lat, lon, map_eligible) with coordinates of geocodes (label, g_lat, g_lon) where they had none; labels in any case."""
    key = F.lower(F.trim("place_label"))
    codes = geocodes.select(F.lower(F.trim("label")).alias("_label"), "g_lat", "g_lon").dropDuplicates(["_label"])
    out = events.withColumn("_label", key).join(codes, "_label", "left")
    pending = F.col("lat").isNull() & F.col("g_lat").isNotNull()
    return out.withColumns(
        {"geocoded": pending, "lat": F.coalesce("lat", "g_lat"), "lon": F.when(F.col("lat").isNull(), F.col("g_lon")).otherwise(F.col("lon")), "map_eligible": F.col("map_eligible") | pending}
    ).drop("_label", "g_lat", "g_lon")


def judged_fragments(fragments: DataFrame, snapshots: DataFrame, judgments: DataFrame, accepted: bool, keys: list[str], source: str | None = None) -> DataFrame:
    """Fragments of snapshots that a judgment accepts, or that none has met; keys join fragments and judgments."""
    if source is not None:
        snapshots = snapshots.filter(F.col("source") == source)
    rows = fragments.join(snapshots, "snapshot_id")
    return rows.join(judgments.filter("accepted"), keys, "left_semi") if accepted else rows.join(judgments, keys, "left_anti")


def claim_sentences(sentences: DataFrame, pages: DataFrame, entities: DataFrame, candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Sentences (sentence_id, page_id) without claims so far whose entity is known: the page's, by its title, else one of its candidates' (the least)."""
    of_page = pages.join(entities.select(F.col("entity_id").alias("_page_entity"), "title"), "title", "left")
    of_candidate = candidates.filter("entity_id is not null").groupBy("sentence_id").agg(F.min("entity_id").alias("_candidate_entity"))
    rows = sentences.join(used.select("sentence_id"), "sentence_id", "left_anti").join(of_page, "page_id").join(of_candidate, "sentence_id", "left")
    return rows.withColumn("entity_id", F.coalesce("_page_entity", "_candidate_entity")).filter("entity_id is not null").drop("_page_entity", "_candidate_entity")


def abstained(decided: DataFrame) -> DataFrame:
    """decided candidates (see ``stage.decide``) with conflict, and status needs_review for competing readings, uncertain for what was read before one."""
    rows = decided.join(disputes(decided), "stem", "left").withColumn("conflict", F.col("outcome") == "needs_review")
    status = F.when(F.col("conflict"), "needs_review").when(F.col("disputed") > F.col("event_id"), "uncertain").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("disputed")


def backfill_claims(events: DataFrame, claimed: DataFrame, evidence: DataFrame, sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """A claim for each event (event_id, event_type, text, confidence) that has none in claimed, with its best evidence.

    evidence: event_id, evidence_id, quoted_text, sentence_id, confidence; the best is the surest (nulls last), then the first by id.
    sentences: sentence_id, page_id, sentence. pages: page_id, lang, title, revision. The evidence is ranked by a sum that
    combines before the shuffle, and only the best meets its sentence and page. quote and locator are null without evidence.
    """
    rank = F.struct(F.coalesce("confidence", F.lit(float("-inf"))).alias("c"), (-F.col("evidence_id")).alias("i"))
    best = evidence.groupBy("event_id").agg(F.max_by(F.struct("quoted_text", "sentence_id"), rank).alias("e")).select("event_id", "e.*")
    best = best.join(sentences, "sentence_id", "left").join(pages, "page_id", "left")
    quote = F.coalesce("quoted_text", "sentence")
    whole = F.col("lang").isNotNull() & F.col("title").isNotNull() & F.col("revision").isNotNull()
    locator = F.when(whole, F.concat(F.lit("https://"), "lang", F.lit(".wikipedia.org/w/index.php?title="), F.replace("title", F.lit(" "), F.lit("_")), F.lit("&oldid="), F.col("revision").cast("string")))
    best = best.select("event_id", quote.alias("quote"), locator.alias("locator"))
    kind = F.when(F.col("event_type") == "anecdote", "anecdote").otherwise("life_event")
    rows = events.join(claimed.select("event_id"), "event_id", "left_anti").join(best, "event_id", "left")
    return rows.select("event_id", kind.alias("kind"), F.lit("attested").alias("status"), F.lit("direct").alias("relation"), "confidence", "text", "quote", "locator")


MENTIONS = "array<struct<surface: string, kind: string, role: string>>"


def resolve_mentions(candidates: DataFrame, entities: DataFrame, surface: str, thing: str | None = None, participants: str | None = None, key: str | None = None) -> DataFrame:
    """Adds place_label, place_kind, mention_role, invalid_place, and the arrays place_mentions, object_mentions, participant_mentions (surface, kind, role).

    A place surface that names a known entity (surface, label, kind) of another kind is no place but a
    participant (persons) or an object; unknown surfaces stay as unresolved places; empty ones give
    nothing. ``thing``, a column of object surfaces: persons among them are participants. ``participants``,
    a column of array<struct<surface, role>>: each keeps its role; ``key`` names the candidate's id then.
    Equal joins on the surface in lower case; unknown kinds are called unknown.
    """
    known = entities.select(F.lower(F.trim("surface")).alias("_surface"), F.col("label").alias("_label"), F.col("kind").alias("_kind")).dropDuplicates(["_surface"])

    def looked_up(rows: DataFrame, column: str, name: str) -> DataFrame:
        side = known.select(F.col("_surface").alias(f"_{name}"), F.col("_label").alias(f"_{name}_label"), F.col("_kind").alias(f"_{name}_kind"))
        rows = rows.withColumn(f"_{name}_raw", F.nullif(F.trim(column), F.lit("")))
        return rows.withColumn(f"_{name}", F.lower(f"_{name}_raw")).join(side, f"_{name}", "left")

    mention = lambda label, kind, role: F.struct(label.alias("surface"), kind.alias("kind"), role.alias("role"))
    none = F.lit(None).cast("string")
    rows = looked_up(candidates, surface, "place")
    given, kind = F.col("_place_raw").isNotNull(), F.col("_place_kind")
    label = F.coalesce("_place_label", "_place_raw")
    is_place = given & (kind.isNull() | (kind == "place"))
    other = given & ~is_place
    people, things = [F.when(other & (kind == "person"), mention(label, kind, F.lit("spouse")))], [F.when(other & (kind != "person"), mention(label, kind, none))]
    if thing is not None:
        rows = looked_up(rows, thing, "thing")
        told, what = F.coalesce("_thing_label", "_thing_raw"), F.coalesce("_thing_kind", F.lit("unknown"))
        people.append(F.when(what == "person", mention(told, what, F.lit("spouse"))))
        things.append(F.when(F.col("_thing_raw").isNotNull() & (what != "person"), mention(told, what, none)))
    if participants is not None:
        each = looked_up(candidates.select(key, F.posexplode(participants).alias("_n", "_p")).select(key, "_n", F.col("_p.surface").alias("_said"), F.col("_p.role").alias("_role")), "_said", "one")
        found = mention(F.coalesce("_one_label", "_said"), F.coalesce("_one_kind", F.lit("unknown")), F.col("_role"))
        listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_n"), found.alias("m")))).alias("_listed"))
        rows = rows.join(listed.select(key, F.transform("_listed", lambda x: x["m"]).alias("_own")), key, "left")
    own = F.coalesce("_own", F.array().cast(MENTIONS)) if participants is not None else F.array().cast(MENTIONS)
    rows = rows.withColumns(
        {
            "place_label": F.when(is_place, label),
            "place_kind": F.when(is_place, F.coalesce(kind, F.lit("unknown"))),
            "mention_role": F.when(other, F.when(kind == "person", "participant").otherwise("object")),
            "invalid_place": F.coalesce(other, F.lit(False)),
            "place_mentions": F.array_compact(F.array(F.when(is_place, mention(label, F.coalesce(kind, F.lit("unknown")), none)))).cast(MENTIONS),
            "object_mentions": F.array_compact(F.array(*things)).cast(MENTIONS),
            "participant_mentions": F.concat(F.array_compact(F.array(*people)).cast(MENTIONS), own),
        }
    )
    return rows.drop(*[c for c in rows.columns if c.startswith(("_place", "_thing", "_own"))])


def human_entities(humans: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """humans with the entity_id of the first key that an entity has too, in order; is_new where none does. Keys are unique in entities."""
    out, found = humans, []
    for k in keys:
        of = entities.filter(F.col(k).isNotNull()).select(F.col(k), F.col("entity_id").alias(f"_by_{k}"))
        out, found = out.join(of, k, "left"), [*found, f"_by_{k}"]
    return out.withColumn("entity_id", F.coalesce(*found)).withColumn("is_new", F.col("entity_id").isNull()).drop(*found)


def sections_of_pages(sections: DataFrame, pages: DataFrame, lang: str, title: str | None = None, pattern: str | None = None) -> DataFrame:
    """Sections (page_id, ordinal, title, body) with page_title, lang and revision of their pages (page_id, lang, page_title, revision):
    of the page with that title, or of all whose title fits a LIKE pattern in any case. Pages are filtered before the join."""
    wanted = pages.filter(F.col("lang") == lang)
    if title is not None:
        wanted = wanted.filter(F.col("page_title") == title)
    if pattern is not None:
        wanted = wanted.filter(F.ilike("page_title", F.lit(pattern)))
    return sections.join(wanted.select("page_id", "page_title", "lang", "revision"), "page_id")


def pending_candidates(candidates: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pending phrase candidates (sentence_id, status, ...) with the text of their sentence (sentence_id, sentence)."""
    return candidates.filter("status = 'pending'").join(sentences.select("sentence_id", "sentence"), "sentence_id")


def ranked_hits(hits: DataFrame, known: DataFrame, search: str, most: int | None = None) -> DataFrame:
    """hits (search, qid, score) with place, the rank within their search: those known here (qid) first, then by score, then by qid. ``most``: only so many of each search."""
    rows = hits.join(known.select("qid").distinct().withColumn("local", F.lit(True)), "qid", "left").withColumn("local", F.coalesce("local", F.lit(False)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(search).orderBy(F.desc("local"), F.desc("score"), "qid")))
    return rows if most is None else rows.filter(F.col("place") <= most)


# Fixed values.
DEBATED_KINDS = ["theory", "controversy", "debate_stance"]


def claims_of(claims: DataFrame, debates_only: bool = False) -> DataFrame:
    """Claims (kind, relation, ...): all, or those that debates are made of: debated kinds and what historiography says."""
    return claims.filter(F.col("kind").isin(DEBATED_KINDS) | (F.col("relation") == "historiography")) if debates_only else claims


def exportable_claims(claims: DataFrame) -> DataFrame:
    """The claims that can be handed on as debates: of debated kinds."""
    return claims.filter(F.col("kind").isin(DEBATED_KINDS))


def conflicting_claims(decided: DataFrame) -> DataFrame:
    """By claim (stem and place) of disputed stems: person, event_type, its first candidate and how many support it."""
    disputed = decided.filter("outcome = 'needs_review'").select("stem").distinct()
    claims = decided.groupBy("stem", "place").agg(F.min("person").alias("person"), F.min("event_type").alias("event_type"), F.min("event_id").alias("first_id"), F.count("*").alias("support"))
    return claims.join(disputed, "stem", "left_semi")


def by_sitelinks(humans: DataFrame, entities: DataFrame, key: str, links: str) -> DataFrame:
    """humans (entity_id: null where no key was found, ``links``: titles in order) with the entity of the first title that an entity (entity_id, title) has."""
    titles = humans.filter("entity_id is null").select(key, F.posexplode(links).alias("_n", "title"))
    found = titles.join(entities.select("title", F.col("entity_id").alias("_found")), "title").groupBy(key).agg(F.min_by("_found", "_n").alias("_found"))
    out = humans.join(found, key, "left").withColumn("entity_id", F.coalesce("entity_id", "_found")).drop("_found")
    return out.withColumn("is_new", F.col("entity_id").isNull())


DENSITY = ["documents_discovered", "documents_snapshotted", "fragments", "candidates", "rejected", "needs_review", "claims", "accepted_events", "timeline_eligible", "map_eligible", "events_without_place", "multi_source_events"]


def density_counts(runs: DataFrame, discovered: DataFrame, snapshots: DataFrame, fragments: DataFrame, decided: DataFrame, events: DataFrame) -> DataFrame:
    """By subject the twelve counts of DENSITY.

    runs: run_id, subject. discovered: run_id. snapshots: snapshot_id, subject. fragments: snapshot_id.
    decided: candidates with subject, outcome, stem, place (a stem and place is a claim). events:
    subject, year, mapped, support. Each table is summed once; only the sums meet by subject.
    """
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    timed, mapped = F.col("year").isNotNull(), F.col("mapped")
    parts = [
        discovered.join(runs, "run_id").groupBy("subject").agg(F.count("*").alias("documents_discovered")),
        snapshots.groupBy("subject").agg(F.count("*").alias("documents_snapshotted")),
        fragments.join(snapshots, "snapshot_id").groupBy("subject").agg(F.count("*").alias("fragments")),
        decided.groupBy("subject").agg(F.count("*").alias("candidates"), n(F.col("outcome") == "rejected", "rejected"), n(F.col("outcome") == "needs_review", "needs_review")),
        decided.select("subject", "stem", "place").distinct().groupBy("subject").agg(F.count("*").alias("claims")),
        events.groupBy("subject").agg(F.count("*").alias("accepted_events"), n(timed, "timeline_eligible"), n(mapped, "map_eligible"), n(timed & ~mapped, "events_without_place"), n(F.col("support") > 1, "multi_source_events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "subject", "full")
    return out.fillna(0, DENSITY).select("subject", *DENSITY)
