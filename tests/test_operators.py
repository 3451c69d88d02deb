from pyspark.sql import functions as F

from annals.functions import ident, place, text, time
from annals.operators import assembly, corpus, judge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_categories(spark):
    def kind(verb, sentence="", person="Ann Lee"):
        i = one(spark, judge.category(F.lit(verb), F.lower(F.lit(sentence)), F.lower(F.lit(person))))
        return judge.CATEGORIES[i] if i >= 0 else ("life_event", verb, "other")

    assert kind("studied")[0] == "education"  # and not death
    assert kind("received")[0] == "meeting"  # that rule comes before awards
    assert kind("born", "Legend has it that he was born at sea")[0] == "anecdote"
    assert kind("born", "A statue shows where he was born")[0] == "statue"
    assert kind("", "He died in Rome")[1] == "died"
    assert kind("sat", "He sat")[2] == "other"


def test_deaths_of_others(spark):
    cases = [
        ("died", "Her daughter Leopoldine drowned in the Seine in 1843.", "Victor Hugo", True),
        ("died", "Hugo died in Paris, and his wife wept.", "Victor Hugo", False),  # the last name is enough
        ("", "After the king's death he left.", "Ann Lee", True),
        ("died", "Ann Lee's death shook the town.", "Ann Lee", False),
        ("died", "A person died near the sea.", "Ann Lee", False),  # no relative: "son" doesn't stand alone
        ("died", "The person and the son died.", "Ann Lee", False),  # the first "son" decides
        ("born", "His brother was buried there.", "Ann Lee", False),  # nobody says died
        ("died", "He died, his mother said.", "Al", True),
    ]
    for verb, sentence, person, want in cases:
        assert one(spark, judge.others_death(F.lit(verb), F.lower(F.lit(sentence)), F.lower(F.lit(person)))) is want, sentence


def test_verdicts(spark):
    rows = [("Ann Lee", "born", "1805", "Paris", "Ann Lee was born in Paris in 1805."), ("Ann Lee", "born", "", "Paris", "x"), ("Ann Lee", "born", "soon", "Paris", "x"), ("Ann", "", "44 BC", "Nowhere", "Ann reportedly sat.")]
    got = judge.judge(spark.createDataFrame(rows, "person string, verb string, time_surface string, place_surface string, sentence string")).collect()
    assert [(r.verdict, r.score, r.status, r.year) for r in got] == [("accept", 100, "established", 1805), ("reject", 10, "uncertain", None), ("reject", 20, "uncertain", None), ("accept", 75, "rumor", -44)]
    assert got[0].title == "Ann Lee born in Paris (1805)" and got[0].map_eligible and not got[3].map_eligible


def test_claims(spark):
    kind = lambda s: one(spark, judge.claim_class(F.lit(s), 1))
    assert [kind(s) for s in ("A disputed theory", "It is said that he wrote", "She argued that", "He was born in 1805", "during the war", "plain")] == ["controversy", "anecdote", "theory", "life_event", "context", "fact"]


def test_times(spark):
    year = lambda s: one(spark, time.parse_year(F.lit(s)))
    assert [year(s) for s in ("1805.", "44 BC", "5000 BC", "999", "12 May 1805", "2101", "in b.c. 31")] == [1805, -44, None, None, None, None, -31]
    assert one(spark, time.years(F.lit("in 31 BC, 1805 and 12345, then 1990"))) == [-31, 1805, 1990]


def test_places(spark):
    best = lambda s: one(spark, place.best_in_text(F.lit(s)))
    assert [best(s) for s in ("From Egypt to Rome", "in Russia", "comparison", "New York, not London")] == ["rome", "russia", None, "new york"]
    assert [best(s) for s in ("at Villequier in Sardinia", "the Clos Luce", "Lützen", "Boulogne-sur-Mer, France", "in Vilna and Milan")] == ["villequier", "clos luce", "lützen", "boulogne-sur-mer", "milan"]
    assert one(spark, place.best_in_text(F.lit("in Notre-Dame de Paris"), "title")) == "Notre-Dame"
    assert [one(spark, place.coordinates(F.lit(s))["lat"]) for s in ("Compiegne", "compiègne", "Nowhere")] == [49.4179, 49.4179, None]
    good = lambda s: one(spark, place.plausible(F.lit(s)))
    assert [good(s) for s in ("Saint Helena", "the hills", "old town", "X", "March", "1805", "Paris on")] == [True, False, False, False, False, False, False]


def test_gates(spark):
    base = {"cross_clause": False, "has_evidence": True, "is_duplicate": False, "place_kind": "place", "event_type": "battle", "year": 1774, "birth_year": 1769, "death_year": 1821, "has_birth": True, "has_death": True, "subject_id": 1}
    cases = [({}, "rejected", "implausible_age_for_event_type"), ({"year": 1805}, "accepted", ""), ({"year": None}, "needs_review", ""), ({"year": 1830}, "rejected", "event_after_subject_death"), ({"event_type": "birth"}, "rejected", "singleton_cardinality_violation"), ({"year": 1805, "place_kind": "unknown", "has_evidence": False}, "rejected", "missing_evidence,invalid_place_kind"), ({"year": 1760}, "rejected", "event_before_subject_birth,implausible_age_for_event_type")]
    schema = "cross_clause boolean, has_evidence boolean, is_duplicate boolean, place_kind string, event_type string, year int, birth_year int, death_year int, has_birth boolean, has_death boolean, subject_id int"
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _, _ in cases], schema).coalesce(1)
    assert [(r.status, ",".join(r.rejection_codes)) for r in assembly.apply_gates(rows).collect()] == [(s, c) for _, s, c in cases]


def test_keys(spark):
    key = lambda p: one(spark, ident.occurrence_stem(F.lit(" Ann  Lee"), F.lit("birth"), F.lit("born"), F.lit("exact:1805:0:0"), F.lit("")))
    full = lambda p: one(spark, ident.occurrence_key(F.lit("ann lee"), F.lit("birth"), F.lit("born"), F.lit("exact:1805:0:0"), F.lit(p), F.lit("")))
    assert key("Paris") == key("Fontainebleau") == full("") != full("Paris") == full(" PARIS ")
    norm = lambda s, r: one(spark, ident.normalize_identifier(F.lit(s), F.lit(r)))
    assert [norm(*x) for x in (("nnt", "2010-pa-1"), ("ppn", "PPN 12"), ("doi", "https://doi.org/10.1/AB"), ("isbn13", "978-2"), ("num_sujet", "12"), ("ark", " "))] == ["2010PA1", "12", "10.1/ab", None, "s12", None]
    assert one(spark, text.slug(F.lit(" Éléonore d'A  ")))== "eleonore-d-a"


def test_merges(spark):
    old = spark.createDataFrame([(1, "person"), (2, "place"), (3, "unknown")], "id int, kind string")
    new = spark.createDataFrame([(1, "unknown"), (2, "work"), (3, "work"), (4, "unknown")], "id int, kind string")
    assert sorted(map(tuple, corpus.conditional_upsert(old, new, "id", "kind").collect())) == [(1, "person"), (2, "place"), (3, "work"), (4, "unknown")]
    rows = spark.createDataFrame([("a", 1, 50), ("a", 2, 60), ("a", 3, 10), ("b", 1, 500)], "s string, n int, size int")
    assert sorted(map(tuple, corpus.within_budget(rows, "s", ["n"], "size", 5, 115).collect())) == [("a", 1, 50), ("a", 2, 60)]


def test_stores(spark, tmp_path):
    from annals.operators import store

    path = str(tmp_path / "t")
    store.replace_children(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, s string"), path, "page")
    store.replace_children(spark.createDataFrame([(1, "d")], "page int, s string"), path, "page")
    assert sorted((r.page, r.s) for r in spark.read.parquet(path).collect()) == [(1, "d"), (2, "c")]
    path = str(tmp_path / "a")
    store.append_new(spark.createDataFrame([(1, "a"), (1, "a")], "id int, s string"), path, ["id"], None)
    store.append_new(spark.createDataFrame([(1, "b"), (2, "c")], "id int, s string"), path, ["id"], spark.read.parquet(path))
    assert sorted((r.id, r.s) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_person_classes(spark):
    from annals.operators import persons

    rows = spark.createDataFrame([("Ann", "general"), ("Ann", "Queen of X"), ("Bob", "clerk"), ("Cy", "poet"), ("Cy", "chemist")], "person string, occupation string")
    got = {r.person: (list(r.classes), r.primary, r.military) for r in persons.person_classes(rows).collect()}
    assert got == {"Ann": (["military_leader", "ruler"], "military_leader", True), "Bob": ([], "unknown", False), "Cy": (["scientist", "artist_writer"], "scientist", False)}


def test_linked_titles(spark):
    from annals.operators.titles import linked_titles, merged_titles

    s = "After the Battle of Jena came the Siege of New York; the Battle of Jena, the treaty of x, and the Treaty of Saint-Cloud."
    assert one(spark, linked_titles(F.lit(s))) == ["Battle of Jena", "Siege of New York", "Treaty of Saint-Cloud"]
    s = "La BATAILLE DE Valmy (1792), le traite de Lunéville\net la bataille de Valmy; the battle of his life, the battle of Ulm. Le siège de Toulon"
    assert one(spark, linked_titles(F.lit(s))) == ["Battle of Ulm", "Bataille de Valmy", "Bataille de Valmy", "Siège de Toulon", "Traité de Lunéville"]
    rows = spark.createDataFrame([("Ann Lee", t, i) for i, t in enumerate(["Zoo", "Lee House", "ann lee", "Ann Lee", "Category:X", "1805", "Treaty of Rome", "zoo"])], "subject string, title string, seq int")
    assert [(r.title, r["rank"]) for r in merged_titles(rows, 3).orderBy("place").collect()] == [("ann lee", 0), ("Lee House", 1), ("Treaty of Rome", 2)]
