"""Phrase tuples, read by hand."""

from annals.operators.phrases import extract_phrases


def tuples(spark, rows, **kw):
    df = spark.createDataFrame([(b, i, s, p) for i, (b, s, p) in enumerate(rows)], "batch int, i int, text string, page string")
    found = extract_phrases(df, "text", "page", "batch", "i", **kw).collect()
    return {i: [(r.person, r.time, r.place, r.verb) for r in sorted(found, key=lambda r: r.ordinal) if r.i == i] for i in range(len(rows))}


def test_layouts(spark):
    got = tuples(
        spark,
        [
            (0, "Alan Turing was born in 1912 in London.", None),
            (0, "The son of Bob Stone studied at Some College in 1801;", None),
            (0, "Ann Lee met Bob in 1790 in Lyon", None),
            (0, "Ann Lee met Bob in Lyon in 1790", None),
            (0, "Ann Lee died in Lyon in 17900", None),
            (0, "Ann Lee lived in the north and south in 1790", None),
            (0, None, None),
            (0, "It was late. Bo died in 1790 in Lyon", None),
        ],
    )
    assert got[0] == [("Alan Turing", "1912", "London", "born")]  # the dense tuple is the same
    assert got[1] == [("Bob Stone", "1801", "Some College", "studied")]
    assert got[2] == [("Ann Lee", "1790", "Lyon", "met")]
    assert got[3] == []  # between the two "in" stands no year
    assert got[4] == got[5] == got[6] == got[7] == []


def test_several_tuples_and_each_once(spark):
    got = tuples(spark, [(0, "Napoleon resided in Elba in 1814 and lived in Elba in 1814", None), (0, "Napoleon fought at Jena in 1806, then was exiled to Elba in 1814", None)])
    # the residence ends at the last "in", which makes its place a piece of a sentence
    assert got[0] == [("Napoleon", "1814", "Elba", "lived")]
    assert got[1] == [("Napoleon", "1814", "Elba", "exiled"), ("Napoleon", "1814", "Elba", "fought")]


def test_carry_needs_a_hook_and_ends_with_page_and_batch(spark):
    page = "Napoleon"
    rows = [
        (0, "In 1806 the army stood at Jena.", page),
        (0, "He signed nothing.", page),
        (0, "Nobody signed.", page),
        (0, "A statue of 1807 stands in Rome.", page),
        (0, "So he fled.", page),
        (0, "He fled.", "Cleopatra"),
        (1, "He fled.", page),
        (1, "In 1805 he was crowned in Milan", "Marie Curie"),
        (1, "She lived there.", "Marie Curie"),
    ]
    got = tuples(spark, rows)
    assert got[0] == [] and got[1] == [("Napoleon", "1806", "Jena", "signed")] and got[2] == []
    assert got[3] == [] and got[4] == [("Napoleon", "1806", "Jena", "exiled")]  # memorials pass nothing on
    assert got[5] == [] and got[6] == []
    assert got[8] == []  # 1805 is no year of Curie's


def test_pages_give_subject_place_and_verb(spark):
    got = tuples(spark, [(0, "It was agreed in 1807.", "Treaty of Tilsit (1807)"), (0, "In 1807 it ended.", "Battle of Friedland"), (0, "In 30 BC she ruled.", "Cleopatra"), (0, "She died, 30 BC, at Alexandria", "Cleopatra")], places=[("alexandria", "Alexandria")])
    assert got[0] == [("Napoleon", "1807", "Tilsit", "signed")] and got[1] == [("Napoleon", "1807", "Friedland", "fought")]
    assert got[2] == [] and got[3] == [("Cleopatra", "30 BC", "Alexandria", "died")]


def test_a_place_is_looked_for_once_and_by_pattern(spark):
    import re

    from pyspark.sql import functions as F

    from annals.operators.phrases import listed_place, ordered_places, page_place

    def plain(low, places):
        alone = lambda n: (at := low.find(n)) >= 0 and not re.match("[a-z0-9]", low[at - 1 : at] if at else "") and not re.match("[a-z0-9]", low[at + len(n) : at + len(n) + 1])
        return next((t for n, t in places if alone(n)), None)

    names = [n for n, _ in ordered_places()]
    texts = ["", "parisian in paris", "xparis, rome", "(rome)", "é paris2 elba", *[f"in {a}, {b}s {b}" for a, b in zip(names, names[5:] + names[:5], strict=True)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for places in (ordered_places(), [("rome", "First"), ("paris", "P"), ("rome", "Second"), ("", "Empty")], []):
        got = {r.t: r.place for r in rows.select("t", listed_place(F.col("t"), places).alias("place")).collect()}
        assert got == {t: plain(t, places) for t in texts}
    plan = rows.select(page_place(F.col("t"), [("rome", "Rome")]).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan
