"""Queries of content-addressed facts: debates as graphs of atoms and triples, fingerprints of records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annals.functions import canon
from annals.plans.corpus import read
from annals.plans.events import STAGED, staged

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


SLUG = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"
SHA_TRIPLE = lambda s, p, o, role: f"""sha256('{{"object":"' || {o} || '","predicate":"' || {p} || '","role":"{role}","subject":"' || {s} || '","v":1}}')"""


@query(
    "graph_fingerprints",
    f"""{STAGED}, d as (select stem, any_value(person) as person, any_value(event_type) as event_type, min(event) as event_id, any_value(time_key) as time_key from staged group by stem),
    c as (select distinct stem, place from staged where place <> '' and stem in (select stem from staged where competes)),
    g as (select c.stem, place, event_id, 'question:' || {SLUG("'where-' || person || '-' || event_type || '-' || time_key")} as q, 'proposition:' || {SLUG("'at-' || place")} as p,
                 'event:' || {SLUG("'canonical-event-' || event_id")} as e, 'place:' || {SLUG("place")} as w from c join d using (stem)),
    f as (select *, {SHA_TRIPLE("q", "'predicate:has-proposition'", "p", "question_has_proposition")} as t1, {SHA_TRIPLE("p", "'predicate:about'", "e", "proposition_about_event")} as t2,
                 {SHA_TRIPLE("e", "'predicate:at'", "w", "event_at_place")} as t3 from g)
    select stem, place, q as question, p as proposition, q || '|predicate:has-proposition|' || p as target, t1 as target_fingerprint,
           sha256('{{"fragment":"' || substr(p, 13) || '","kind":"proposition","v":1}}') as proposition_fingerprint,
           case when event_id is null then 4 else 8 end as n_atoms, sha256(case when event_id is null then t1 else array_to_string(list_sort([t1, t2, t3]), '|') end) as fingerprint from f""",
)
def graph_fingerprints(spark, sf_dir):
    """The debates over competing places, each reading a bundle of atoms and triples addressed by their digests."""
    least = [F.min(c).alias(c) for c in ("person", "event_type", "time_key")]
    places = F.collect_set(F.nullif("place", F.lit(""))).alias("places")
    groups = staged(spark, sf_dir).groupBy("stem").agg(*least, F.min("event").alias("event_id"), places, F.bool_or(F.col("outcome") == "needs_review").alias("disputed"))
    readings = groups.filter("disputed").withColumn("place", F.explode("places"))
    question = F.concat_ws("-", F.lit("where"), "person", "event_type", "time_key")
    b = readings.withColumn("b", canon.bundle(question, F.concat(F.lit("at-"), "place"), F.col("event_id"), F.col("place"), F.col("person")))
    t = F.col("b.target")
    return b.select(
        "stem", "place", t["subject"].alias("question"), t["object"].alias("proposition"), t["key"].alias("target"), t["fingerprint"].alias("target_fingerprint"),
        F.filter("b.atoms", lambda a: a["kind"] == "proposition")[0]["fingerprint"].alias("proposition_fingerprint"), F.size("b.atoms").alias("n_atoms"), F.col("b.fingerprint").alias("fingerprint"),
    )


J = lambda c: f"coalesce(to_json({c})::varchar, 'null')"


@query(
    "record_fingerprints",
    f"""select doc_id, sha256('{{"abstract_text":' || {J("text")} || ',"academic_status":"unknown","access_level":"open","contributions":[["author",' || {J("lang")} || ',null,null,0],["editor","A \\\\ B","orcid",' || {J("source")} || ',1]]'
        || ',"document_type":"article","external_id":' || {J("doc_id::varchar")} || ',"full_text_available":' || (n_chars > 2000)::varchar || ',"identifiers":' || case when doc_id % 3 = 0 then '[]' else '[["doi","10.1/' || doc_id || '"]]' end
        || ',"language":' || {J("lang")} || ',"publication_time":null,"publisher_or_institution":' || {J("case when doc_id % 2 = 0 then source end")} || ',"rights_normalized":"unknown","snapshot_text":' || {J("text[:50]")}
        || ',"source_kind":' || {J("source")} || ',"subjects":[["local",' || {J("lang")} || ',null]],"title":' || {J("text[:20]")} || '}}') as fingerprint from documents""",
)
def record_fingerprints(spark, sf_dir):
    """Fingerprints of bibliographic records made from documents: identity, metadata, contributions and texts."""
    d = read(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.col("text")
    lit = F.lit
    no = lit(None).cast("string")
    person = lambda role, name, scheme, value, n: F.struct(role.alias("role"), name.alias("name"), scheme.alias("identifier_scheme"), value.alias("identifier_value"), lit(n).alias("ordinal"))
    record = d.select(
        "doc_id", F.col("source").alias("source_kind"), key.cast("string").alias("external_id"), lit("article").alias("document_type"), F.substring(text, 1, 20).alias("title"), F.col("lang").alias("language"),
        text.alias("abstract_text"), lit("unknown").alias("academic_status"), lit("open").alias("access_level"), (F.col("n_chars") > 2000).alias("full_text_available"), lit("unknown").alias("rights_normalized"),
        F.when(key % 2 == 0, F.col("source")).alias("publisher_or_institution"), no.alias("publication_time"),
        F.when(key % 3 != 0, F.array(F.struct(lit("doi").alias("scheme"), F.concat(lit("10.1/"), key.cast("string")).alias("value")))).alias("identifiers"),
        F.array(person(lit("author"), F.col("lang"), no, no, 0), person(lit("editor"), lit("A \\ B"), lit("orcid"), F.col("source"), 1)).alias("contributions"),
        F.array(F.struct(lit("local").alias("scheme"), F.col("lang").alias("label"), no.alias("identifier"))).alias("subjects"), F.substring(text, 1, 50).alias("snapshot_text"),
    )
    fields = StructType([f for f in record.schema.fields if f.name != "doc_id"])
    return record.select("doc_id", canon.record_fingerprint(fields).alias("fingerprint"))
