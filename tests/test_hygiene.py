"""Dimensions beyond one block, deep templates, mined sentences, folded names."""

from pyspark.sql import functions as F

from annals.functions import text
from annals.operators import corpus, mine, reads
from annals.operators.explore import reachable


def test_dimensions_of_any_size(spark):
    spans = spark.createDataFrame([(i, 1700 + i, 1705 + i) for i in range(40)], "k int, start_year int, end_year int")
    periods = spark.createDataFrame([(f"p{i}", 1700 + 3 * i, 1701 + 3 * i) for i in range(20)], "period string, first_year int, last_year int")
    rows = lambda most: sorted(map(tuple, corpus.overlapping(spans, periods, most).collect()))
    assert rows(3) == rows(1000) == sorted((k, a, b, p, c, d) for k, a, b in spans.collect() for p, c, d in periods.collect() if b >= c and a <= d)
    docs = spark.createDataFrame([(1, "Letters of Élise Dupont", "about nothing", "Anna", None), (2, "x", "Anna said", None, "zz")], "doc_id int, title string, abstract string, author string, keyword string")
    aliases = spark.createDataFrame([("e", "elise dupont"), ("a", "Anna"), ("z", "zz"), ("n", "nobody")], "subject string, alias string")
    assert sorted(map(tuple, corpus.match_subjects(docs, aliases).collect())) == [(1, "a", "by", 35, "author"), (1, "e", "about", 45, "title"), (2, "a", "about", 35, "abstract")]


def test_budget_counts_rows_first(spark):
    rows = spark.createDataFrame([("s", i, 10) for i in range(9)] + [("t", 1, 99), ("t", 2, 1)], "g string, k int, b int")
    assert sorted((r.g, r.k) for r in corpus.within_budget(rows, "g", ["k"], "b", 3, 25).collect()) == [("s", 0), ("s", 1)]


def test_templates_nest_to_any_depth(spark):
    deep = "{{a " * 12 + "x" + "}}" * 12
    cases = [(f"one {deep} two", "one two"), ("a {{b}} c", "a c"), ("open {{ stays", "open {{ stays"), (f"{deep}{deep} z", "z")]
    for given, want in cases:
        assert spark.range(1).select(text.wikitext_to_plain(F.lit(given))).first()[0] == want


def test_mined_sentences(spark):
    lines = [
        ("p1", 1, "According to legend, Napoleon slept only four hours a night while campaigning near Austerlitz in 1805.", "Napoleon"),
        ("p2", 1, "A statue of Napoleon was unveiled in 1865 in Paris after his death.", "Napoleon"),
        ("p3", 1, "Marie Curie was born in 1867 in Warsaw and later worked with radium.", "Marie Curie"),
        ("p4", 1, "In 1891, Curie followed her sister to study in Paris.", "Marie Curie"),
        ("p5", 1, "In 1843 his daughter Léopoldine drowned at Villequier and was buried there.", "Victor Hugo"),
        ("p6", 1, "Hugo arrived in Jersey in August 1852 with others.", "Some page"),
        ("p6", 2, "In exile he wrote long poems on sea and stars.", "Les Misérables"),
        ("p6", 3, "Long poems were published about the sea and stars.", "Les Misérables"),
        ("p7", 1, "Nobody known was born in Paris in 1805, it appears.", "Some page"),
        ("p8", 1, "Cleopatra fled to Egypt in 31 BC after the battle.", "x"),
        ("p9", 1, "Too short 1805 Paris.", "Napoleon"),
    ]
    rows = spark.createDataFrame(lines, "page string, n int, sentence string, title string")
    got = {(r.page, r.n): (r.person, r.time, r.place, r.verb) for r in mine.mined(rows, "sentence", "title", ["page"], "n").collect()}
    assert got == {
        ("p1", 1): ("Napoleon", "1805", "Austerlitz", "anecdoted"),
        ("p3", 1): ("Marie Curie", "1867", "Warsaw", "born"),
        ("p4", 1): ("Marie Curie", "1891", "Paris", "studied"),
        ("p5", 1): ("Victor Hugo", "1843", "Villequier", "grieved"),
        ("p6", 1): ("Victor Hugo", "1852", "Jersey", "moved"),
        ("p6", 2): ("Victor Hugo", "1852", "Jersey", "published"),
        ("p8", 1): ("Cleopatra", "31 BC", "Egypt", "exiled"),
    }


def test_names_match_without_accents(spark):
    names = spark.createDataFrame([("Éloïse", ["Elo"]), ("Anna", ["Náná"]), ("Bob", None)], "name string, aliases array<string>")
    match = lambda p: [r.name for r in names.filter(reads.person_match(F.col("name"), p, F.col("aliases"))).collect()]
    assert match("eloi") == ["Éloïse"] and match("NANA") == ["Anna"] and match("x") == []


def test_reachable_stops_when_all_is_seen(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src int, dst int")
    assert sorted(map(tuple, reachable(edges, spark.createDataFrame([(1,)], "node int"), 5).collect())) == [(1, 0), (2, 1), (3, 2)]
