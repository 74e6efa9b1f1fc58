"""Captured credits of a film database as rows of people, cast and portraits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinomill.functions.text import image_url, normalized, profile_image_id, trimmed

CREDITS = "cast array<struct<id:int,name:string,character:string,profile_path:string>>"
PROFILES = "profiles array<struct<file_path:string,width:int,height:int,vote_average:double>>"


def cast_rows(captured: DataFrame, allowed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Every role of the cast of captured credits (``title_id``, ``json``), in billing order.

    Members without a number or name drop out.  ``allowed`` (normalized ``name``) keeps the
    names in it: None lets all in, an empty table none.
    """
    rows = captured.select("title_id", F.posexplode(F.from_json("json", CREDITS)["cast"]).alias("billing_order", "m")).select("title_id", "billing_order", "m.*")
    rows = rows.filter((F.col("id") > 0) & (trimmed(F.coalesce("name", F.lit(""))) != "")).withColumn("normalized_name", normalized(F.col("name")))
    if most is not None:
        rows = rows.filter(F.col("billing_order") < most)
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("name").alias("normalized_name")).distinct(), "normalized_name", "left_semi")
    return rows.withColumnRenamed("id", "person")


def people(cast: DataFrame) -> DataFrame:
    """One row for each person, as first billed."""
    return cast.groupBy("person").agg(F.min_by(F.struct("name", "normalized_name", "profile_path"), F.struct("title_id", "billing_order")).alias("p")).select("person", "p.*")


def portraits(captured: DataFrame, base: str, size: str = "w500") -> DataFrame:
    """Portraits of captured lists (``person``, ``json``): a stable id, an address, the place in the list."""
    rows = captured.select("person", F.posexplode(F.from_json("json", PROFILES)["profiles"]).alias("source_index", "m")).select("person", "source_index", "m.*")
    rows = rows.filter(trimmed(F.coalesce("file_path", F.lit(""))) != "")
    path: Column = F.col("file_path")
    return rows.select("person", "source_index", profile_image_id(F.col("person"), path).alias("image_id"), image_url(base, path, size).alias("source_url"), "width", "height", F.lit("pending").alias("status"))
