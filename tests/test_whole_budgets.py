from annals import plans


def test_long_documents_shut_out_none_of_forty(spark, tmp_path):
    rows = [(i, "x" * 70_000 if i == 0 else "é", "s") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in plans.QUERIES["source_budgets_whole"](spark, str(tmp_path)).collect()) == list(range(40))


def test_the_timeline_has_more_than_its_first_500_events(spark):
    assert plans.QUERIES["timeline_whole"](spark, "/root/testdata/sf0.001").count() > 500
