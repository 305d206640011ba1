import __spark_entry__ as entry
from ledgerloom.streaming import live


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5, 3), ("b", 2, 6, 4), ("c", 3, 90 * 86_400_000_000, 4)], "k string, event_us long, known_us long, amount long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.start_fast_layer(stream, ["k"], "amount", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r["k"]: int(r["amount"]) for r in live.fast_view(spark.read.parquet(str(tmp_path / "out")), ["k"]).collect()} == {"a": 3, "b": 4}
