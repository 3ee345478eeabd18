"""The flipped blocks of the benchmark items are shuffled, not gathered in the driver."""

from skillgrid.llm import decontam


def test_flipped_blocks_are_not_broadcast(spark):
    items = spark.createDataFrame([("a", 20, 0), ("b", 20, -1), ("c", 30, 0)], "item string, n int, ifp long")
    prints = spark.createDataFrame([(20, 1), (20, 0x7FFFF), (20, 0xFFFFF), (20, -2), (30, 3)], "n int, fp long")
    got = decontam._near(prints, items)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(20, -2, "b"), (20, 1, "a"), (20, 0x7FFFF, "a"), (30, 3, "c")]
