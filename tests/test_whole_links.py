from annals import plans

SF = "/root/testdata/sf0.001"


def test_exploration_reaches_every_order_of_a_seed(spark):
    found = {r.node for r in plans.QUERIES["exploration_whole"](spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").filter("o_custkey in (1, 2, 4)").collect()
    assert orders and {f"order {r.o_orderkey}" for r in orders} <= found
    assert len(found) > 211


def test_all_odd_events_are_merged(spark, tmp_path):
    spark.createDataFrame([(2, 3, "a"), (5, 1, "a")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in plans.QUERIES["merge_found_whole"](spark, str(tmp_path)).collect()} == {2, 5}
