"""Tab-separated title and name snapshots, allow-lists and JSON lines.

Lines have no quoting or escaping.  Compressed snapshots cannot be split, so they are
spread over the cluster right after they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.functions import numbers, text

#: Columns of a media line.
MEDIA = {
    "media_id": "string", "movie_id": "string", "type": "string", "title": "string", "original_title": "string", "year": "int", "duration": "double", "language": "array<string>", "description": "string",
    "tags": "array<string>", "source_url": "string", "metadata": "string",
    "scenes": "array<struct<scene_id:string,start:double,end:double,preview:string,caption:string,subtitle:string,quality_score:float,person_ids:array<string>>>",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (a number that grows along each file) and ``line``."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    if path.lower().endswith(".gz"):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    return lines


def fields(lines: DataFrame, least: int, header: str) -> DataFrame:
    """``line_no`` and ``f``, the fields of lines that have enough of them; headers and shorter lines drop out."""
    f = F.split(F.regexp_replace("line", "\r$", ""), "\t", -1)
    rows = lines.select("line_no", f.alias("f")).filter(F.size("f") >= least)
    return rows.filter(F.get("f", F.lit(0)) != header)


def _at(i: int) -> Column:
    return text.present(F.coalesce(F.get("f", F.lit(i)), F.lit("")))


def titles(lines: DataFrame) -> DataFrame:
    rows = fields(lines, 9, "tconst")
    return rows.select(
        "line_no", _at(0).alias("title_id"), _at(1).alias("title_type"), _at(2).alias("title"), _at(3).alias("original_title"), (_at(4) == "1").alias("is_adult"),
        numbers.positive_year(_at(5)).alias("year"), numbers.positive_year(_at(6)).alias("end_year"), numbers.count_or_zero(_at(7)).alias("runtime_minutes"), text.comma_list(_at(8)).alias("genres"),
    )


def ratings(lines: DataFrame) -> DataFrame:
    """The last line of a title wins."""
    rows = fields(lines, 3, "tconst").select("line_no", _at(0).alias("title_id"), numbers.decimal_or_zero(_at(1)).alias("average_rating"), numbers.count_or_zero(_at(2), "bigint").alias("vote_count"))
    return rows.groupBy("title_id").agg(F.max_by(F.struct("average_rating", "vote_count"), "line_no").alias("r")).select("title_id", "r.*")


def alternates(lines: DataFrame) -> DataFrame:
    """Region, language and the mark of an original title may be absent."""
    rows = fields(lines, 3, "titleId")
    return rows.select(
        "line_no", _at(0).alias("title_id"), numbers.count_or_zero(_at(1)).alias("ordering"), _at(2).alias("title"), _at(3).alias("region"), _at(4).alias("language"), (_at(7) == "1").alias("is_original")
    ).filter("title <> ''")


def crew(lines: DataFrame) -> DataFrame:
    return fields(lines, 3, "tconst").select("line_no", _at(0).alias("title_id"), text.comma_list(_at(1)).alias("directors"), text.comma_list(_at(2)).alias("writers"))


def principals(lines: DataFrame, categories: tuple[str, ...] = ("actor", "actress")) -> DataFrame:
    rows = fields(lines, 6, "tconst").select(
        "line_no", _at(0).alias("title_id"), numbers.count_or_zero(_at(1)).alias("ordering"), _at(2).alias("name_id"), _at(3).alias("category"), _at(4).alias("job"), _at(5).alias("characters")
    )
    return rows.filter(F.col("category").isin(*categories))


def names(lines: DataFrame) -> DataFrame:
    rows = fields(lines, 6, "nconst")
    return rows.select(
        "line_no", _at(0).alias("name_id"), _at(1).alias("name"), numbers.positive_year(_at(2)).alias("birth_year"), numbers.positive_year(_at(3)).alias("death_year"),
        text.comma_list(_at(4)).alias("professions"), text.comma_list(_at(5)).alias("known_for"),
    )


def allowed_ids(lines: DataFrame) -> DataFrame:
    """Ids of a list with comments after ``#``; each once."""
    ids = text.trimmed(F.regexp_replace("line", "#.*$", ""))
    return lines.select(ids.alias("title_id")).filter("title_id <> ''").distinct()


def media_lines(spark: SparkSession, path: str) -> DataFrame:
    """Media of a file of JSON lines; a bad line stops the load, a missing id is made from the line."""
    rows = spark.read.schema(", ".join(f"{name} {kind}" for name, kind in MEDIA.items())).option("mode", "FAILFAST").json(path)
    return rows.withColumn("media_id", F.when(F.coalesce("media_id", F.lit("")) == "", F.md5(F.to_json(F.struct(*MEDIA)))).otherwise(F.col("media_id")))
