"""Requests that bring a content already seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.lineage import list_path, remove_path, scratch_path
from kinomill.llm.forest import HashForest, canonical
from kinomill.plans.registry import SPACE, sql_trim
from kinomill.tables import table


def _record(source: int, batch: Column, request: Column, video: Column, media: Column) -> Column:
    return F.struct(
        F.lit(source).alias("source"), batch.cast("int").alias("batch"), request.cast("long").alias("request"), video.alias("video"), media.alias("media_id")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    videos = table(spark, folder, "videos").select(
        F.col("media_id").alias("key"),
        canonical(F.col("fingerprint")).alias("content"),
        _record(0, F.lit(0), F.lit(0), F.coalesce("media_id", F.lit("")), F.col("media_id")).alias("record"),
    )
    requests = table(spark, folder, "requests").select(
        F.coalesce("batch_no", F.lit(0)).alias("batch_no"),
        F.col("request_id").alias("key"),
        canonical(F.col("source_fingerprint")).alias("content"),
        _record(1, F.coalesce("batch_no", F.lit(0)), F.col("request_id"), F.lit(""), F.col("media_id")).alias("record"),
    )
    forest = HashForest(spark)
    forest.accept(videos, level=2)
    # the requests are read and made comparable once, then each batch comes from its own folder
    arrived = scratch_path(spark, "requests")
    requests.write.partitionBy("batch_no").parquet(arrived)
    content = requests.drop("batch_no").schema
    for batch in sorted(int(name.rpartition("=")[2]) for name in list_path(spark, arrived) if name.startswith("batch_no=")):
        forest.accept(spark.read.schema(content).parquet(f"{arrived}/batch_no={batch}"))
    remove_path(spark, arrived)
    return forest.seen_before(requests.drop("batch_no")).select(F.col("key").alias("request_id"), F.col("first.media_id").alias("media_id"))


#: The digits of a fingerprint in SQL, or its remote id; white space by Unicode, as in the operator.
_TEXT = f"lower({sql_trim('f')})"
_PLAIN = f"regexp_replace({_TEXT}, '[{SPACE}:._-]', '', 'g')"
_UNTAGGED = f"regexp_replace(regexp_replace({_TEXT}, '^([a-z][a-z0-9]*[{SPACE}]*[:=][{SPACE}]*)?(0x)?', ''), '[{SPACE}:._-]', '', 'g')"
_CONTENT = f"CASE WHEN starts_with({_TEXT}, 'remote:') THEN {_TEXT} WHEN regexp_full_match({_PLAIN}, '[0-9a-f]{{64}}') THEN {_PLAIN} WHEN regexp_full_match({_UNTAGGED}, '[0-9a-f]{{64}}') THEN {_UNTAGGED} END"
_APART = " + ".join(f"CAST(bit_count(xor(a.w{i}, b.w{i})) AS INTEGER)" for i in range(4))

QUERIES = {"p3_found": p3_found}
ORACLES = {
    "p3_found": f"""
        WITH coming AS (
            SELECT DISTINCT 0 AS source, 0 AS batch, CAST(0 AS BIGINT) AS request, media_id AS video, media_id, fingerprint AS f FROM videos
            UNION ALL SELECT DISTINCT 1, batch_no, request_id, '', media_id, source_fingerprint FROM requests),
        read AS (SELECT *, {_CONTENT} AS content FROM coming),
        placed AS (SELECT *, row_number() OVER (ORDER BY source, batch, request, video) AS n FROM read WHERE content IS NOT NULL),
        cut AS (SELECT *, {", ".join(f"CASE WHEN NOT starts_with(content, 'remote:') THEN CAST('0x' || substr(content, {1 + 16 * i}, 16) AS UBIGINT) END AS w{i}" for i in range(4))} FROM placed)
        SELECT b.request AS request_id, arg_min(a.media_id, a.n) AS media_id FROM cut a JOIN cut b ON a.n < b.n AND (a.content = b.content OR {_APART} <= 12)
        WHERE b.source = 1 GROUP BY b.request""",
}
