"""The task log as a stream.

The log is read with ``AvailableNow``, so a run handles what is there and ends, and its
result equals the batch form's.  Unlike a subscriber with a bounded buffer that drops
its oldest events, a stream is slowed down by its reader and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinomill.lineage import exists, scratch_path
from kinomill.operators.index import replace_table
from kinomill.operators.tasks import checked_commands, latest_states


def file_stream(spark: SparkSession, folder: str, name: str, files_at_once: int = 100) -> DataFrame:
    """A table's files as a stream, in the order of their appearance."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path, only = (folder, f"{name}.parquet") if _is_file(spark, f"{folder}/{name}.parquet") else (f"{folder}/{name}.parquet", "*.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", only).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def latest_of_stream(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key. Every micro-batch writes its own last events; together they are few rows for each key."""
    spark = events.sparkSession
    path = scratch_path(spark, "latest")

    def write(batch: DataFrame, number: int) -> None:
        latest_states(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_states(spark.read.schema(events.schema).option("basePath", path).parquet(path).drop("batch"), key, order)


def progress_of_stream(events: DataFrame, key: str, order: str, percent: str, state: str, terminal: tuple[str, ...]) -> DataFrame:
    """For each key the highest percent and the first terminal state; what comes after a terminal state is ignored.

    The state of a key is three values.  Events of a key are handled in order within a
    micro-batch and across micro-batches.
    """
    spark = events.sparkSession
    kind = dict(events.dtypes)[key]
    path = scratch_path(spark, "progress")

    def advance(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best, ended, seen = held.get if held.exists else (0.0, "", 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for value, name in zip(rows[percent], rows[state], strict=True):
            if ended:
                break
            seen += 1
            best = min(1.0, max(best, float(value)))
            if name in terminal:
                ended = name
        held.update((best, ended, seen))
        yield pd.DataFrame({key: [k[0]], "percent": [best], "ended": [ended], "seen": [seen]})

    schema = f"{key} {kind}, percent double, ended string, seen long"
    states = events.groupBy(key).applyInPandasWithState(advance, schema, "percent double, ended string, seen long", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part-{number:09d}")

    states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    results = spark.read.schema(f"{schema}, number int").parquet(f"{path}/part-*")
    return latest_states(results, key, ["number"]).drop("number")


def kept_snapshot(events: DataFrame, path: str, key: str, order: list[str], every: str | None = None) -> None:
    """Keeps the latest state of each key in the table ``path`` while events come.

    With ``every`` (as ``500 milliseconds``) a batch is written that often at most and
    the stream goes on; without it what is there is handled and the stream ends.  The
    table is replaced whole, as a snapshot is, after each batch.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(events.schema).parquet(path).unionByName(batch) if exists(spark, path) else batch
        replace_table(latest_states(known, key, order), path)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch_path(spark, 'snapshot')}-state")
    if every:
        writer.trigger(processingTime=every).start()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()


def checked_stream(commands: DataFrame, media: DataFrame) -> DataFrame:
    """Commands that came as a stream, each checked against the media as they are when its batch is handled."""
    spark = commands.sparkSession
    path = scratch_path(spark, "commands")
    checked = checked_commands(commands, media)
    checked.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(checked.schema).parquet(path)


def first_seen_of_stream(rows: DataFrame, fingerprint: str, time: str, delay: str) -> DataFrame:
    """Rows whose fingerprint did not come before within ``delay``; the state of older fingerprints is dropped."""
    spark = rows.sparkSession
    path = scratch_path(spark, "first")
    fresh = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([fingerprint])
    fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
