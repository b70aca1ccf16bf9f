import datetime as dt

from mailposture.streaming.observations import dedup_stream

START = dt.datetime(2024, 1, 1)


def test_repeats_inside_and_outside_the_time_to_live(spark, tmp_path):
    """Batches with repeated, late and expired observations; every one goes on where the last one ended."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], "kind string, domain string, observed_at timestamp").write.parquet(source)

    def arrive(*rows):
        frame = spark.createDataFrame([("scrape", d, START + dt.timedelta(days=day)) for d, day in rows], "kind string, domain string, observed_at timestamp")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = dedup_stream(spark.readStream.schema(frame.schema).parquet(source), "1 day")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.domain, (r.observed_at - START).days) for r in spark.read.parquet(out).collect())

    assert arrive(("a", 0), ("a", 0), ("b", 0)) == [("a", 0), ("b", 0)]
    assert arrive(("a", 0.5), ("c", 0.75)) == [("a", 0), ("b", 0), ("c", 0)]  # inside
    assert arrive(("d", 5)) == [("a", 0), ("b", 0), ("c", 0), ("d", 5)]
    assert arrive(("a", 6), ("b", 1), ("d", 5.5)) == [("a", 0), ("a", 6), ("b", 0), ("c", 0), ("d", 5)]  # outside; late; inside
