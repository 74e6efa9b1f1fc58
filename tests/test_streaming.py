from pyspark.sql import functions as F

from kinomill.operators.tasks import latest_states
from kinomill.streaming import tasks as stream

ROWS = [("a", 1, "queued", 0.1), ("a", 2, "running", 0.7), ("b", 1, "running", 0.2), ("a", 3, "running", 0.4), ("b", 2, "failed", 0.3), ("b", 3, "running", 0.9), ("c", 1, "running", 5.0)]
SCHEMA = "id string, n int, state string, percent double"


def written(spark, tmp_path):
    """The log in three files, so that it comes in several micro-batches."""
    for i in range(3):
        part = [r for r in ROWS if r[1] == i + 1]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    return stream.file_stream(spark, str(tmp_path), "log", files_at_once=1)


def test_latest_equals_the_batch_form(spark, tmp_path):
    events = written(spark, tmp_path)
    batch = latest_states(spark.createDataFrame(ROWS, SCHEMA), "id", ["n"])
    assert sorted(map(tuple, stream.latest_of_stream(events, "id", ["n"]).collect())) == sorted(map(tuple, batch.collect()))


def test_progress_never_falls_and_ends_once(spark, tmp_path):
    got = stream.progress_of_stream(written(spark, tmp_path), "id", "n", "percent", "state", ("failed",))
    assert {r["id"]: (r["percent"], r["ended"], r["seen"]) for r in got.collect()} == {"a": (0.7, "", 3), "b": (0.3, "failed", 2), "c": (1.0, "", 1)}


def test_first_seen(spark, tmp_path):
    timed = written(spark, tmp_path).withColumn("ts", F.timestamp_seconds(F.col("n") * 60))
    assert sorted(r["id"] for r in stream.first_seen_of_stream(timed, "id", "ts", "1 day").collect()) == ["a", "b", "c"]
