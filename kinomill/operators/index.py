"""Keeping the index of media and scenes: validation, replacement, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinomill.functions.text import cleaned_ids, trimmed
from kinomill.lineage import exists, scratch_path


def settled_media(media: DataFrame) -> DataFrame:
    """Defaults filled in: the type, and the quality of scenes."""
    scenes = F.transform("scenes", lambda s: s.withField("quality_score", F.when(F.coalesce(s["quality_score"], F.lit(0.0)) == 0, F.lit(1.0)).otherwise(s["quality_score"]).cast("float")))
    return media.withColumns({"type": F.when(F.coalesce(F.col("type"), F.lit("")) == "", "movie").otherwise(F.col("type")), "scenes": scenes})


def media_errors() -> Column:
    """What is wrong with a media row: an array, empty if nothing is."""

    def wrong(condition: Column, name: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), name)

    scenes = F.col("scenes")
    return F.array_compact(
        F.array(
            wrong(F.coalesce(trimmed(F.col("title")), F.lit("")) == "", "title"),
            wrong(F.coalesce(F.size(scenes), F.lit(0)) <= 0, "scenes"),
            wrong(~F.col("year").between(1888, 3000), "year"),
            wrong(F.col("duration") < 0, "duration"),
            wrong(F.exists(scenes, lambda s: (s["start"] < 0) | (s["start"] >= s["end"])), "interval"),
            wrong(F.exists(scenes, lambda s: ~s["quality_score"].between(0, 1)), "quality"),
        )
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of all old rows of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_media(media: DataFrame, scenes: DataFrame, new_media: DataFrame, new_scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New media replace old ones with all of their scenes; a scene id taken over from another media goes to the new one."""
    ids = new_media.select("media_id").distinct()
    kept = scenes.join(ids, "media_id", "left_anti").join(new_scenes.select("scene_id").distinct(), "scene_id", "left_anti")
    return upsert(media, new_media, "media_id"), kept.select(*scenes.columns).unionByName(new_scenes)


def delete_media(media: DataFrame, scenes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of media and scenes, and for each id whether it was there; ids are trimmed and count once."""
    ids = ids.select(trimmed(F.col("media_id")).alias("media_id")).filter("media_id <> ''").distinct()
    outcome = ids.join(media.select("media_id", F.lit(True).alias("deleted")).distinct(), "media_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return media.join(ids, "media_id", "left_anti"), scenes.join(ids, "media_id", "left_anti"), outcome


def delete_scenes(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scenes go only where they belong to the media named with them."""
    return scenes.join(pairs.select("media_id", "scene_id").distinct(), ["media_id", "scene_id"], "left_anti")


def update_people(scenes: DataFrame, updates: DataFrame) -> DataFrame:
    """New person lists for scenes; the last update of a scene (by ``n``) counts, ids are trimmed and count once."""
    last = updates.groupBy("media_id", "scene_id").agg(F.max_by("person_ids", "n").alias("new_ids"))
    joined = scenes.join(last, ["media_id", "scene_id"], "left")
    return joined.withColumn("person_ids", F.coalesce(cleaned_ids(F.col("new_ids")), "person_ids")).drop("new_ids")


def sticky(old: Column, new: Column) -> Column:
    """A non-empty value is not overwritten by an empty one."""
    return F.coalesce(F.when(new != "", new), old)


def overwrite_by_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of old rows that share any of the keys."""
    for key in keys:
        old = old.join(new.select(key).distinct(), key, "left_anti")
    return old.select(*new.columns).unionByName(new)


def nest_scenes(media: DataFrame, scenes: DataFrame) -> DataFrame:
    """Media with their scenes in order of start; media without scenes keep an empty list. The scenes of a media are one row."""
    fields = ["start", *(c for c in scenes.columns if c not in ("start", "media_id"))]
    lists = scenes.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("scenes"))
    return media.join(lists, "media_id", "left")


def public_scenes(scenes: Column, base: str) -> Column:
    """Scenes as shown outside: previews by address, no local paths."""
    return F.transform(scenes, lambda s: s.withField("preview", F.when(F.coalesce(s["preview"], F.lit("")) != "", F.concat(F.lit(base), s["preview"])).otherwise("")).dropFields("preview_path"))


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table ``path``, empty with ``schema`` if there is none yet. A folder that holds no rows is an empty table; a file that cannot be read is an error when it is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines, none if it is absent or empty; a broken line is an error when it is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` (which may read ``path``) aside and then moves it into place."""
    spark = df.sparkSession
    aside = scratch_path(spark, "aside")
    df.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    if source.getFileSystem(conf).getUri().equals(files.getUri()):
        files.rename(source, target)
    else:
        spark.read.parquet(aside).write.parquet(path)
    files.delete(old, True)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
