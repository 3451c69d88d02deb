from annals import plans

SF = "/root/testdata/sf0.001"


def test_every_turn_of_evidence_has_its_band(spark):
    evidence = spark.read.parquet(f"{SF}/conversations.parquet").filter("contains(text, 'the')").select("conv_id", "turn").distinct()
    marked = plans.QUERIES["narrative_context_whole"](spark, SF).filter("is_evidence").select("conv_id", "turn").distinct()
    assert evidence.exceptAll(marked).isEmpty() and evidence.filter("turn % 7 <> 0").count() > 0
