from pyspark.sql import functions as F

from tektonis.streaming import events


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("t").collect()


def test_windows_sessions_and_state(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", u, v) for u in ("a", "b") for h, m, v in ((0, 5, 1.0), (0, 50, None), (2, 0, 4.0))]
    df = spark.createDataFrame(rows, "t string, u string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: events.read_folder(spark, str(tmp_path / "in"), df.schema)
    got = {(r.u, r.start.hour): (r.total, r.n) for r in run(events.windowed_rollup(stream(), "t", ["u"], "v"), "complete")}
    assert got[("a", 0)] == (1.0, 2) and got[("b", 2)] == (4.0, 1)
    assert sorted((r.u, r.n) for r in run(events.sessions(stream(), "t", "u", "1 hour"), "complete")) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert len(run(events.once(stream().withColumn("k", F.hour("t")), "k", "t"))) == 2
    lines = spark.createDataFrame([(1, "k", "x"), (1, None, "y")], "d bigint, k string, v string").coalesce(1)
    lines.write.parquet(str(tmp_path / "lines"))
    out = run(events.carry_forward(events.read_folder(spark, str(tmp_path / "lines"), lines.schema), "d", "k", "v"), "append")
    assert sorted(map(tuple, out)) == [(1, "k", "x"), (1, "k", "y")]
