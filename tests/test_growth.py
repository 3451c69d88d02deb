"""What rows and tasks hold doesn't grow with the tables; shapes of plans that only show at size."""

from pyspark.sql import functions as F

from annals.plans import record_queries
from annals.sources import records

SF = "/root/testdata/sf0.001"


def parts_of(spark, folder: str, times: int) -> str:
    """The parts table, repeated with shifted keys."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.expr("p_partkey + copy * 10000")).drop("copy").write.parquet(f"{folder}/part.parquet")
    return folder


def test_pages_of_an_answer_dont_grow_with_the_table(spark, tmp_path):
    longest = lambda d, sql: record_queries.over(spark, d, sql, "part").agg(F.max(F.length("items"))).first()[0]
    once, more = parts_of(spark, f"{tmp_path}/1", 1), parts_of(spark, f"{tmp_path}/9", 9)
    for sql in (record_queries.SEARCHED, record_queries.HARVESTED):
        assert longest(more, sql) < 2 * longest(once, sql)
    got = record_queries.library_notices(spark, more)
    broken = [r.p_brand for r in got.filter("problem = 'broken'").collect()]
    assert len(broken) == len(set(broken)) > 0  # several pages of a search that can't be read are one row
    assert got.filter("problem is null or problem <> 'broken'").count() == 9 * record_queries.library_notices(spark, once).filter("problem is null or problem <> 'broken'").count()


def test_records_dont_carry_their_page(spark):
    rows = spark.createDataFrame([("<r><records/></r>",)], "payload string").withColumn("payload", F.concat("payload", F.lit("")))
    for harvest in (False, True):
        plan = records.dublin_core(rows, harvest=harvest).select("external_id", "problem", "token")._jdf.queryExecution().optimizedPlan().toString()
        generate = next(line for line in plan.splitlines() if "Generate explode" in line)
        below = plan.splitlines()[plan.splitlines().index(next(x for x in plan.splitlines() if "Generate explode" in x)) + 1]
        assert "_found" in generate and "_bad" in below and "[_x" not in below, plan


def test_place_names_are_found_by_pattern(spark):
    import re

    from annals.functions.place import best_in_text, gazetteer, standing_alone

    rows = gazetteer()
    first = {n: (loc, len(n.encode()), -i) for i, (n, _, _, loc) in enumerate(rows)}
    assert all(any(re.search(p, f"({n})").group(1) == n for p in standing_alone(tuple(first)) if re.search(p, f"({n})")) for n in first)

    def plain(text):
        low = text.translate({c: c + 32 for c in range(65, 91)})
        alone = lambda n: (at := low.find(n)) >= 0 and not re.match("[a-z0-9]", low[at - 1 : at] if at else "") and not re.match("[a-z0-9]", low[at + len(n) : at + len(n) + 1])
        return max((n for n in first if alone(n)), key=first.get, default=None)

    names = list(first)
    texts = ["", "Parisian in Paris", "paris", "x paris2 Rome", "ÉParis", *[f"In {a}, {b.upper()}-{a}s" for a, b in zip(names, names[7:] + names[:7], strict=True)], *[f"{a}s or {b} {a}" for a, b in zip(names, names[1:], strict=False)]]
    got = {r.t: r.place for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", best_in_text(F.col("t")).alias("place")).collect()}
    assert got == {t: plain(t) for t in texts} and len(set(got.values())) > 50


def test_clauses_and_sentences_are_lower_cased_once(spark):
    from annals.operators.debates import sentence_hit
    from annals.operators.judge import predicate_of

    rows = spark.range(3).select(F.concat(F.lit("Scholars DISPUTE whether he was Born in "), F.col("id").cast("string")).alias("s"))
    lowered = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(")
    assert lowered(predicate_of(F.col("s"), 1)) == 1 and lowered(sentence_hit(F.col("s"))) == 1


def test_words_of_event_types_are_looked_for_once_a_sentence(spark):
    from annals import rules
    from annals.operators.dossier import relevant, worded

    rows = spark.createDataFrame([("he died there", "death"), ("he died there", "battle"), ("nothing", "death"), ("in it", "other"), ("1801 x", "battle"), ("rome x", "battle")], "s string, t string")
    got = rows.select(relevant(F.col("s"), worded(F.col("s")), F.col("t"), F.lit("rome"), F.lit("1801")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, True, True, True] and rules.EVENT_WORDS[-1][0] is None


def test_parts_read_each_record_once(spark):
    rows = spark.createDataFrame([('{"nnt": "1", "titrePrincipal": "a", "directeurs": [{"nom": "Dir"}, {"nom": " "}]}',), ('{"nnt": "2", "titrePrincipal": "no parts"}',), ('{"titrePrincipal": "no id", "directeurs": [{"nom": "Dir"}]}',), ("{",)], "payload string")
    got = records.parts(records.theses(rows.withColumn("payload", F.concat("payload", F.lit("")))), "contributions")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, plan
    assert [(r.external_id, r.role, r.name) for r in got.collect()] == [("1", "thesis_advisor", "Dir")]


def test_documents_stay_where_they_are_read_when_few_words_have_an_alias(spark):
    from annals.operators import corpus

    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("Saint Helena, Saint Helena "), "id").alias("title"), *[F.lit(c).alias(c) for c in ("abstract", "author", "keyword")])
    aliases = spark.createDataFrame([("h", "helena"), ("h", "Saint Helena"), ("a", "thor")], "subject string, alias string")
    got = corpus.match_subjects(docs, aliases)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "word" in joins[0] and "doc_id" not in joins[0], joins
    rows = sorted(tuple(r) for r in got.filter("doc_id < 2").collect())
    assert rows == [(i, s, *rest) for i in (0, 1) for s, *rest in (("a", "by", 35, "author"), ("h", "about", 45, "title"))] and got.count() == 100


def test_candidates_of_the_stage_are_judged_once(spark, monkeypatch):
    from annals.plans import events

    plans = []
    written = events.written
    monkeypatch.setattr(events, "written", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, label))[1])
    got = events.staged(spark, SF)
    assert len(plans) == 1 and not [line for line in plans[0].splitlines() if "Filter" in line and "regexp_replace" in line]
    assert got.count() == events.keyed(spark, SF).count() > 0 and "verdict" not in got.columns
