"""Catalogue titles that media and resolutions describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinomill.llm.matching import file_title, match_records
from kinomill.tables import table


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "titles").groupBy("title_id").agg(
        F.min("primary_title").alias("primary_title"), F.min("original_title").alias("original_title"), F.min("start_year").alias("year"), F.min("runtime_minutes").alias("minutes")
    )
    akas = table(spark, folder, "title_akas").select("title_id", F.col("title").alias("name"))
    own = titles.select("title_id", F.explode(F.array("primary_title", "original_title")).alias("name"))
    names = own.unionAll(akas).distinct()
    return names.join(titles.select("title_id", "year", "minutes"), "title_id").select(F.col("title_id").alias("entry"), "name", "year", "minutes")


def records(spark: SparkSession, folder: str) -> DataFrame:
    def from_files(names):
        return names.map(file_title)

    resolutions = table(spark, folder, "resolutions").select(
        F.concat(F.lit("resolutions:"), F.col("resolution_id").cast("string")).alias("key"),
        F.array("title", F.pandas_udf(from_files, T.StringType())("file_name")).alias("names"),
        F.col("release_year").alias("year"),
        F.col("duration_sec").alias("seconds"),
    )
    newest = table(spark, folder, "media").groupBy("media_id").agg(F.max(F.struct("updated_at", "title", "original_title", "release_year", "duration_sec")).alias("m"))
    media = newest.select(
        F.concat(F.lit("media:"), "media_id").alias("key"), F.array("m.title", "m.original_title").alias("names"), F.col("m.release_year").alias("year"), F.col("m.duration_sec").alias("seconds")
    )
    return resolutions.unionAll(media)


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = match_records(catalogue(spark, folder), records(spark, folder))
    return found.select(
        F.split_part("key", F.lit(":"), F.lit(1)).alias("record_table"), F.expr("substr(key, instr(key, ':') + 1)").alias("record_key"), F.col("entry").alias("title_id"), "confidence"
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).select("record_table", "record_key", "title_id")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches}
ORACLES: dict[str, str] = {}
