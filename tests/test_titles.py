"""Candidates from the titles of pages, by hand; lines of campaigns that begin."""

from annals.operators import extract

PAGES = "page int, title string, text string, birth_year int, death_year int"


def test_titles_and_fallback(spark):
    rows = [
        (1, " Battle of Jena (1806)", "In 1640, 1806 and 1807", None, 1821), (2, "siege of Toulon.", "no year", 1769, 1821), (3, "Italian Campaign", "44 BC", None, None), (4, "Treaties of Tilsit", "1807", 1769, None),
        (5, "Bataille de Valmy (1792)", "1700 then 1792", 1769, 1821), (6, "Siège de Toulon", "in 1900", 1769, 1821), (7, "Traité de Lunéville", "1801", None, None), (8, "Some page", "1801", None, None), (9, "Battle of ", "1801", None, None), (10, None, "1801", None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    found = extract.campaign_titles(pages)
    got = {r.page: (r.event_type, r.predicate, r.year, r.place) for r in found.collect()}
    assert got == {
        1: ("battle", "fought_at", 1806, "Jena"), 2: ("siege", "besieged", None, "Toulon"), 3: ("military_campaign", "campaign_at", -44, None), 4: ("treaty", "signed", 1807, "Tilsit"),
    }
    rest = {r.page: (r.event_type, r.predicate, r.year, r.place) for r in extract.page_fallback(pages, found).collect()}
    assert rest == {5: ("battle", "fought_at", 1792, "Valmy"), 7: ("treaty", "signed", 1801, "Lunéville")}


def test_campaign_lines(spark):
    lines = ["The campaign began near Lodi, in 1796", "The campaign in Lodi, 1796", "The Campaign opened at Jena, 1806; a siege", "Fought at Jena, 1830"]
    rows = spark.createDataFrame([("p", i, x, 1821) for i, x in enumerate(lines)], "page string, line_no int, line string, death_year int")
    got = sorted((r.line_no, r.event_type, r.predicate, r.year, r.place) for r in extract.military(rows).collect())
    assert got == [(0, "military_campaign", "campaign_at", 1796, "Lodi"), (2, "military_campaign", "campaign_at", 1806, "Jena")]
