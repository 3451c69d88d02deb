"""Canonical JSON and what is addressed by its digest."""

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annals.functions import canon

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
compact = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_canonical_json_of_any_nesting(spark):
    schema = "z string, a struct<y: int, x: array<struct<k: string, b: boolean>>, m: map<string, long>>, n array<array<string>>"
    values = [
        ('q"\\\n\t\x01\x1fé', {"y": None, "x": [{"k": "K", "b": True}, None], "m": {"b": 2, "a": None, "Z": 1}}, [["x"], []]),
        (None, None, None),
        ("", {"y": 3, "x": [], "m": {}}, [None]),
    ]
    df = spark.createDataFrame(values, schema)
    got = [r.j for r in df.select(canon.canonical(F.struct(*df.columns), df.schema).alias("j")).collect()]
    assert got == [compact(dict(zip(("z", "a", "n"), v, strict=True))) for v in values]


def test_json_texts_with_other_key_orders_are_equal(spark):
    texts = ['{"v": 1, "a": 1, "b": {"z": 1, "y": [2, {"d": null, "c": "é"}]}}', '{"b":{"y":[2,{"c":"é","d":null}],"z":1},"a":1,"v":1}', '{"b":{"y":[{"c":"é","d":null},2],"z":1},"a":1,"v":1}', "no json", None]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canon.fingerprint_of_json(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] == sha(compact(json.loads(texts[0]))) and got[2] not in (None, got[0]) and got[3:] == [None, None]


def test_slugs(spark):
    cases = {"La Révolution française!!!": "la-revolution-francaise", "  Foo  Bar  ": "foo-bar", "!!!": "x", "Œuvre de Łódź": "oeuvre-de-lodz", "Straße-Ñ": "strasse-n"}
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert all(r.got == r.want for r in rows.select("want", canon.slug_fragment(F.col("raw")).alias("got")).collect())


def bundles(spark, rows):
    df = spark.createDataFrame(rows, "q string, p string, e long, w string, n string")
    return [r.b for r in df.select(canon.bundle(*[F.col(c) for c in "qpewn"]).alias("b")).collect()]


def test_bundles_depend_on_ids_alone(spark):
    a, b, c, d = bundles(spark, [("Where was Ann?", "at-Paris", 42, "Paris", "Ann"), ("where was ANN", "At: Paris", 42, "paris", "Bob"), ("Where was Ann?", "at-Elba", 42, "Elba", "Ann"), ("Where was Ann?", "at-Paris", None, "Paris", "Ann")])
    ids = {"object": "proposition:at-paris", "predicate": "predicate:has-proposition", "role": "question_has_proposition", "subject": "question:where-was-ann", "v": 1}
    assert a.target.fingerprint == b.target.fingerprint == d.target.fingerprint == sha(compact(ids)) and a.fingerprint == b.fingerprint
    assert a.target.subject == c.target.subject and a.fingerprint != c.fingerprint != d.fingerprint
    assert [t.role for t in a.triples] == ["question_has_proposition", "proposition_about_event", "event_at_place"] and len(d.triples) == 1
    assert {x.id for x in a.atoms} == {"question:where-was-ann", "proposition:at-paris", "predicate:has-proposition", "event:canonical-event-42", "predicate:about", "place:paris", "predicate:at", "person:ann"}
    assert all(x.fingerprint == sha(compact({"v": 1, "kind": x.kind, "fragment": x.id.split(":", 1)[1]})) for x in a.atoms)


def test_records_change_with_any_field(spark):
    schema = T.StructType.fromDDL(canon.RECORD)
    base = dict(source_kind="hal", external_id="1", document_type="thesis", title='A "t"', language="fr", abstract_text=None, academic_status="x", access_level="open", full_text_available=False, rights_normalized="r", publisher_or_institution=None, publication_time="1900", identifiers=[("doi", "10")], contributions=[("author", "ann", None, None, 0)], subjects=None, snapshot_text="s")
    rows = [base] + [base | {k: v} for k, v in dict(title="B", identifiers=[("doi", "11")], contributions=[("author", "ann", None, None, 1)], subjects=[("s", "l", None)], snapshot_text=None, full_text_available=True).items()]
    got = [r.f for r in spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema).select(canon.record_fingerprint(schema).alias("f")).collect()]
    want = base | {"identifiers": [["doi", "10"]], "contributions": [["author", "ann", None, None, 0]], "subjects": []}
    assert got[0] == sha(compact(want)) and len(set(got)) == len(rows)
