import gzip
import json

from pyspark.sql import functions as F

from annals.functions.text import sections, wikitext_to_plain
from annals.sources import files
from annals.streaming.ingest import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_records_and_plan(spark, tmp_path):
    lines = [json.dumps({"external_id": "a", "text": "Ann was here", "language": "en"}), "{broken", "", json.dumps({"external_id": " ", "text": "x"}), json.dumps({"external_id": "b", "text": "Bob", "language": "fr", "external_ids": [["doi", "10.1/x"]]})]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = files.records(spark, str(tmp_path))
    assert rows(got.na.fill("", ["external_id"]), "external_id", "broken", "usable") == [("", True, False), (" ", False, False), ("a", False, True), ("b", False, True)]
    assert rows(files.plan(got, "en", "ann").groupBy("plan").count(), "plan", "count") == [("broken", 1), ("ingest", 1), ("other_language", 1), ("unusable", 1)]


def test_index_seeds_and_dates(spark, tmp_path):
    (tmp_path / "i.txt").write_text("10:1:Paris\nx:2:Battle: of X\n\n5:6\n7:8:\n")
    assert rows(files.multistream_index(spark, str(tmp_path / "i.txt")), "offset", "page_id", "title") == [(0, 2, "Battle: of X"), (10, 1, "Paris")]
    (tmp_path / "s.txt").write_text("# note\nOne\n\n Two \n")
    assert rows(files.seeds(spark, str(tmp_path / "s.txt")), "title") == [("One",), ("Two",)]
    got = spark.createDataFrame([("frwiki-20240102-pages.xml",), ("none.xml",)], "n string").select(files.dump_date(F.col("n")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == ["2024-01-02", None]


def test_wiki_pages(spark, tmp_path):
    page = lambda t, ns, i: f"<page><title>{t}</title><ns>{ns}</ns><id>{i}</id><revision><id>{i}0</id><text>text of {t}</text></revision></page>"
    (tmp_path / "w.xml").write_text(f"<mediawiki>{page('A', 0, 1)}{page('Talk', 1, 2)}{page('B', 0, 3)}</mediawiki>")
    assert rows(files.wiki_pages(spark, str(tmp_path / "w.xml")), "page_id", "title", "revision_id", "text") == [(1, "A", 10, "text of A"), (3, "B", 30, "text of B")]
    assert rows(files.wiki_pages(spark, str(tmp_path / "w.xml"), spark.createDataFrame([(3,)], "page_id long")), "title") == [("B",)]


def test_humans(spark, tmp_path):
    claim = lambda **v: [{"mainsnak": {"datavalue": {"value": v}}}]
    ann = {"type": "item", "id": "Q1", "labels": {"en": {"language": "en", "value": "Ann"}}, "claims": {"P31": claim(id="Q5"), "P569": claim(time="+1769-08-15T00:00:00Z"), "P106": claim(id="Q9")}, "sitelinks": {"enwiki": {"title": "Ann"}}}
    old = {"type": "item", "id": "Q2", "labels": {"fr": {"language": "fr", "value": "Vieux"}}, "claims": {"P31": claim(id="Q5"), "P570": claim(time="-0044-00-00T00:00:00Z"), "P106": claim(id="Q77")}, "sitelinks": {}}
    job = {"type": "item", "id": "Q9", "labels": {"en": {"language": "en", "value": "ruler"}}, "claims": {}, "sitelinks": {}}
    (tmp_path / "e.json").write_text("[\n" + ",\n".join(map(json.dumps, [ann, old, {"type": "property", "id": "P1"}, job])) + "\n]\n")
    got = files.humans(files.entities(spark, str(tmp_path / "e.json")))
    assert rows(got.select("qid", "label", F.coalesce("birth_year", F.lit(0)).alias("b"), F.coalesce("death_year", F.lit(0)).alias("d"), F.array_join("occupations", ",").alias("o")), "qid", "label", "b", "d", "o") == [
        ("Q1", "Ann", 1769, 0, "ruler"),
        ("Q2", "Vieux", 0, -44, "Q77"),
    ]


def test_sparql_and_works(spark, tmp_path):
    cell = lambda v: {"type": "x", "value": v}
    b = [
        {"event": cell("http://e/Q1"), "eventLabel": cell("Battle"), "date": cell("1805-12-02T00:00:00Z"), "geo": cell("Point(16.8 49.1)")},
        {"event": cell("http://e/Q1"), "eventLabel": cell("Battle"), "date": cell("1805-12-02T00:00:00Z"), "geo": cell("Point(16.8 49.1)")},
        {"battle": cell("http://e/Q2"), "battleLabel": cell("No date")},
    ]
    (tmp_path / "q.json").write_text(json.dumps({"results": {"bindings": b}}))
    assert rows(files.sparql_events(spark, str(tmp_path / "q.json")), "event_id", "label", "date", "lat", "lon") == [("Q1", "Battle", "1805-12-02", 49.1, 16.8)]
    w = [{"id": "W1", "display_name": " On X ", "type": "dissertation", "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "doi": "https://doi.org/10.1/A", "authorships": [{"author": {"display_name": "Ann"}}]}, {"id": "W2"}]
    (tmp_path / "w.json").write_text(json.dumps({"results": w}))
    got = files.works(spark, str(tmp_path / "w.json")).collect()
    assert [(r.external_id, r.title, r.abstract, r.document_type, r.doi, r.authors) for r in got] == [("W1", "On X", "hello world hello", "thesis", "10.1/a", ["Ann"])]


def test_text_functions(spark):
    got = spark.range(1).select(wikitext_to_plain(F.lit("<!-- c -->'''Ann''' {{x|{{y}}}}was<ref name=a/> in [[Paris, France|Paris]].<ref>r</ref> [[File:a.jpg]] [[Category:B]]")).alias("t")).first().t
    assert got == "Ann was in Paris."
    pages = spark.createDataFrame([(1, "intro\n== Life ==\nborn\ndied\n=== Work ===\nwrote")], "page long, text string")
    assert rows(sections(pages, "page"), "ordinal", "title", "body") == [(0, "Lead", "intro"), (1, "Life", "born\ndied"), (2, "Work", "wrote")]


def test_stream_resumes(spark, tmp_path):
    drop, table, failed, point = (str(tmp_path / n) for n in ("in", "table", "failed", "cp"))
    (tmp_path / "in").mkdir()
    put = lambda name, *recs: (tmp_path / "in" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in recs))
    put("1.jsonl", {"external_id": "a", "text": "one"}, {"external_id": "a", "text": "one"}, "{bad")
    ingest(spark, drop, table, failed, point).awaitTermination()
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(failed).count() == 1
    put("2.jsonl", {"external_id": "a", "text": "one"}, {"external_id": "a", "text": "two"}, {"external_id": "b", "text": " "})
    ingest(spark, drop, table, failed, point).awaitTermination()
    assert rows(spark.read.parquet(table), "external_id", "text") == [("a", "one"), ("a", "two")]
    assert rows(spark.read.parquet(failed).groupBy("plan").count(), "plan", "count") == [("broken", 1), ("unusable", 1)]


def test_catalogs(spark):
    from annals.sources import catalogs

    item = {"metadata": {"identifier": "abc", "title": ["", "On X"], "date": "1899-01-01", "creator": ["Ann", "Bob"], "mediatype": "texts"}}
    payloads = spark.createDataFrame([(json.dumps(item),), ("{broken",), (None,), ('{"identifier": "no title"}',)], "payload string")
    got = catalogs.archive_items(payloads).collect()
    assert [(r.external_id, r.url, r.title, r.creator, r.year, r.kind) for r in got] == [("abc", "https://archive.org/details/abc", "On X", "Ann", 1899, "texts")]
    xml = "<record><dc:title>Vie &lt;1&gt;</dc:title><dc:identifier>ark:/1</dc:identifier><dc:creator>Élise, Ann</dc:creator><dc:date>1750</dc:date></record>"
    people = [("elise", 1800, None, xml), ("élise", 1740, None, xml), ("Bob", 1800, None, xml), ("Bob", None, None, None)]
    got = catalogs.digitized(spark.createDataFrame(people, "subject string, birth_year int, death_year int, payload string")).collect()
    assert [(r.subject, r.authored, r.notice) for r in got] == [("élise", True, 'élise published "Vie <1>" in 1750.'), ("Bob", False, "Vie <1>")]
