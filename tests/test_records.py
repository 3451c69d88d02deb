"""Readers of nested records, by hand."""

import json

from annals.sources import records


def one(df):
    return df.collect()[0]


def test_a_thesis_with_all_its_parts(spark):
    detail = {
        "nnt": "2020abcd0001", "numSujet": "123", "doi": "https://doi.org/10.1/Ab", "titrePrincipal": " Sur Napoléon ", "status": "soutenue", "accessible": "oui", "resumes": {"fr": " ", "en": "Abs"}, "langues": ["fr"],
        "dateSoutenance": "2020-01-02", "auteurs": [{"nom": "Dupont", "prenom": "Élise", "ppn": "PPN 12X"}, {"nom": "", "prenom": " "}, {"prenom": "Solo"}], "membresJury": [{"nom": "Jury"}], "presidentJury": {"nom": "Pres"},
        "etabSoutenance": {"nom": "Sorbonne", "ppn": "9"}, "ecolesDoctorales": [{"nom": ""}, {"nom": "ED 1"}], "mapSujets": {"mots": [{"keyword": "k1"}], "sujetsRameau": [{"libelle": "R1", "ppn": "5"}]}, "sujetsRameau": [{"libelle": "R2"}], "sujets": [{"libelle": "s"}],
    }
    rows = spark.createDataFrame([(1, json.dumps(detail))], "n int, payload string")
    got = one(records.theses(rows))
    assert (got.n, got.external_id, got.canonical_url, got.document_type, got.academic_status, got.access_level, got.year, got.problem) == (1, "2020abcd0001", "https://theses.fr/2020abcd0001", "thesis", "doctoral_defended", "open", 2020, None)
    assert got.abstract_text is None  # the French one is there, and empty
    assert [(i.scheme, i.value) for i in got.identifiers] == [("nnt", "2020ABCD0001"), ("doi", "10.1/ab"), ("num_sujet", "s123")]
    assert [(c.role, c.name, c.name_normalized, c.identifier, c.ordinal) for c in got.contributions] == [
        ("author", "Élise Dupont", "Élise dupont", "12", 0), ("author", "Solo", "solo", None, 2), ("jury_member", "Jury", "jury", None, 0), ("jury_president", "Pres", "pres", None, 0),
        ("institution", "Sorbonne", "sorbonne", "9", 0), ("doctoral_school", "ED 1", "ed 1", None, 1),
    ]
    assert got.snapshot_text == "TITLE: Sur Napoléon\nSUBJECTS: keyword:k1 | rameau:R1 | rameau:R2 | keyword:s"
    parts = records.parts(records.theses(rows), "subjects").collect()
    assert [(p.external_id, p.scheme, p.label, p.identifier) for p in parts] == [("2020abcd0001", "keyword", "k1", None), ("2020abcd0001", "rameau", "R1", "5"), ("2020abcd0001", "rameau", "R2", None), ("2020abcd0001", "keyword", "s", None)]


def test_problems_are_named(spark):
    rows = spark.createDataFrame([(1, "{broken"), (2, None), (3, "{}"), (4, '{"id":"x"}'), (5, '{"id":"x","titrePrincipal":"T"}')], "n int, payload string")
    assert [r.problem for r in records.theses(rows).orderBy("n").collect()] == ["broken", "broken", "no identifier", "no title", None]
    rows = spark.createDataFrame([(1, "{broken"), (2, None), (3, '{"title_s":"T"}'), (4, '{"halId_s":"h","title_s":[" "]}'), (5, '{"halId_s":"h","title_s":["T","U"],"doi_s":"10.1/X"}')], "n int, payload string")
    got = records.deposits(rows).orderBy("n").collect()
    assert [r.problem for r in got] == ["broken", "broken", "no identifier", "no title", None] and [i.value for i in got[4].identifiers] == ["h", "10.1/x"]


def test_pages_of_dublin_core(spark):
    dc = lambda body: f'<oai_dc:dc xmlns:oai_dc="o" xmlns:dc="d">{body}</oai_dc:dc>'
    page = "<r><records>" + "".join(f"<record><recordData>{dc(b)}</recordData></record>" for b in ("<dc:title>A &lt;1&gt;</dc:title><dc:title>B</dc:title><dc:identifier>http://x/ark:/1/2/</dc:identifier>", "<dc:title/><dc:identifier>id</dc:identifier>")) + "</records></r>"
    rows = spark.createDataFrame([(1, page), (2, "<r><records>"), (3, "<r><records/></r>"), (4, None)], "n int, payload string")
    got = sorted((r.n, r.external_id, r.title, r.problem) for r in records.dublin_core(rows).fillna("", ["external_id", "title", "problem"]).collect())
    assert got == [(1, "ark:/1/2", "A <1>", ""), (1, "id", "", "no title"), (2, "", "", "broken"), (4, "", "", "broken")]
    feed = f"<OAI-PMH><ListRecords><record><header><identifier>oai:1</identifier></header><metadata>{dc('<dc:title>T</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><dc:subject>s</dc:subject><dc:date>1901-02</dc:date>')}</metadata></record><resumptionToken> next </resumptionToken></ListRecords></OAI-PMH>"
    got = one(records.dublin_core(spark.createDataFrame([(feed,)], "payload string"), harvest=True))
    assert (got.external_id, got.token, got.year, [c.name for c in got.contributions], got.snapshot_text) == ("oai:1", "next", 1901, ["Ann", "Bob"], "TITLE: T\nKEYWORDS: s")
