"""Dense clauses, debates, plans and dossiers on cases written by hand."""

from pyspark.sql import functions as F

from annals.operators.debates import debate_section, loose_cuts, passage_hits, source_plan, work_hits
from annals.operators.dense import clauses, dense_clauses
from annals.operators.dossier import claim_text, compact, dossiers, without_heading


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_clauses_keep_byte_offsets(spark):
    pages = spark.createDataFrame([(1, "Né à Rome; il vit.\n\n  Fin"), (2, None), (3, ""), (4, " . ; ")], "page long, text string")
    got = [(r.page, r.sentence_index, r.clause_index, r.clause_text, r.start_offset, r.end_offset) for r in clauses(pages, "page", "text").orderBy("page", "start_offset").collect()]
    assert got == [(1, 0, 0, "Né à Rome", 0, 11), (1, 0, 1, "il vit", 12, 19), (1, 1, 0, "Fin", 21, 24)]


def test_dense_clauses(spark):
    text = "Napoleon was exiled to Elba in 1814; it rained on Paris. He married Joséphine at Paris, 9 March 1796. Died at Saint Helena"
    pages = spark.createDataFrame([(1, text, "Napoleon (general)", "page"), (2, text, None, "chronology_list"), (3, "Yesterday Jean Moulin was born", None, None), (4, None, None, None)], "page long, text string, title string, kind string")
    got = dense_clauses(pages, "page", "text", "title", "kind").orderBy("page", "start_offset").collect()
    assert [(r.page, r.event_type, r.subject_surface, r.time_surface, r.place_surface, r.object_surface) for r in got] == [
        (1, "exile", "Napoleon", "1814", "Elba", None),
        (1, "marriage", "Napoleon", "9 march 1796", "Paris", "Joséphine"),
        (1, "death", "Napoleon", None, "Saint Helena", None),
        (3, "birth", "Yesterday Jean Moulin", None, None, None),
    ]


def test_loose_sentences_are_long_and_whole():
    assert loose_cuts(None) == [] and loose_cuts("Short. No.") == []
    assert loose_cuts("Short. No. But here it goes on! And so") == ["Short. No. But here it goes on!"]
    assert loose_cuts("\n" * 5 + "Twenty-four bytes éé now. tail of more than 24 bytes") == ["Twenty-four bytes éé now.", "tail of more than 24 bytes"]


def test_debates(spark):
    assert one(spark, *[debate_section(F.lit(t)) for t in ("Legacy", "Campaign", "Death in the campaign", "Early life")]) == (True, False, True, False)
    rows = spark.createDataFrame([(1, "Was Columbus Genoese? A theory of Catalan origin exists too."), (2, "Nothing at all is said about anything here."), (3, None)], "id long, body string")
    assert [(r.id, r.ordinal, r.debate_type, r.event_type) for r in passage_hits(rows, "body").collect()] == [(1, 0, "identity_origin_dispute", "birth")]
    works = spark.createDataFrame([(1, "Napoleon, hero or villain", None), (2, "myth", ""), (3, "On bread", "Historians debate the price of bread in the year of his death."), (4, None, None)], "id long, title string, abstract string")
    assert sorted((r.id, r.debate_type, r.event_type or "") for r in work_hits(works, "title", "abstract").collect()) == [(1, "interpretation_dispute", ""), (3, "interpretation_dispute", "death")]


def test_source_plan(spark):
    rows = [("a", ["military_leader"], "military_leader", True, ["en"], []), ("b", ["philosopher"], "philosopher", False, None, None), ("c", [], None, False, [], ["French Guiana"])]
    plan = source_plan(spark.createDataFrame(rows, "subject string, classes array<string>, primary string, military boolean, languages array<string>, countries array<string>")).collect()
    by = {s: {r.source: r for r in plan if r.subject == s} for s in "abc"}
    assert len(by["a"]) == 9 and by["a"]["wikipedia"].priority == 20 and "military signal, 1 facets" in by["a"]["wikipedia"].reason
    assert len(by["b"]) == 13 and by["b"]["open_alex"].priority == 55
    assert by["c"]["open_alex"].priority == 62 and "hal" in by["c"] and by["c"]["bnf"].reason == "BnF catalogue (unknown)"


def test_claim_texts(spark):
    got = one(spark, claim_text(F.lit("A[1] b [Réf. x] c [citation needed] d [kept words] &amp; [ab]")), without_heading(F.lit("C++ (early): x"), F.lit("C++ (early)"), " :—-"), compact(F.lit("Birth — He came,"), F.lit("Life")))
    assert got == ("A b c d [kept words] &", "x", "He came")
    long = "x" * 60 + ". " + "y" * 200
    assert one(spark, compact(F.lit(long), F.lit("Life"))) == ("x" * 60 + ".",)


def test_dossiers_of_events_without_claims(spark):
    events = spark.createDataFrame([(1, "birth", 1769, "Ajaccio", "Ann", "T", None, None, "P", "en", None), (2, "death", None, None, "Ann", "T", None, " Ann died. ", "P", "en", 7)], "event_id long, event_type string, year int, place_label string, person string, title string, summary string, fact string, page string, language string, revision long")
    narrative = spark.createDataFrame([], "event_id long, ordinal int, text string, is_evidence boolean")
    sentences = spark.createDataFrame([], "page string, section_no int, section string, ordinal long, text string")
    got = {r.event_id: r for r in dossiers(events, narrative, sentences).collect()}
    assert (got[1].event_summary, got[1].how_it_happened, got[1].source_refs) == ("T", "T", [])
    assert got[2].how_it_happened == "Ann died.[1]" and got[2].source_refs[0].url == "https://en.wikipedia.org/w/index.php?title=P&oldid=7"
