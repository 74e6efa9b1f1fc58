"""Which catalogue title a media is, from its ids and names, in tiers.

1. its own id; 2. a clean name that equals a title (in the order of the names, a title of
the expected year first); 3. the best-scored title that shares a telling word with the
media, where the year of the media is known; 4. a title one of whose alternate names
equals a name; 5. the best-scored title after all.  Candidates are found by equality of words, not by
comparing every media with every title.  As a search gives a hundred titles at most,
each word brings in the first :data:`CANDIDATES` of its titles: those that are the word,
those that begin with it, then by name, year and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinomill.functions import text


#: Titles that a word brings in, at most: what a search gives.
CANDIDATES = 100


def media_names(media: DataFrame) -> DataFrame:
    """``media_id``, ``n``, ``hint``, ``year``: the names of a media and what they say as file names, in order."""
    hints = text.title_hints([F.col("title"), F.col("original_title"), F.col("remote_name")])
    rows = media.select("media_id", "year", F.posexplode(hints).alias("n", "hint"))
    said = text.resolved_name(F.col("hint"))["year"]
    return rows.select("media_id", "n", "hint", F.coalesce("year", said).alias("year"))


def resolve(media: DataFrame, titles: DataFrame, alternates: DataFrame) -> DataFrame:
    """``media_id``, ``title_id``, ``tier``; media that no tier resolves have no row."""
    own = media.join(titles.select(F.col("title_id").alias("movie_id")), "movie_id").select("media_id", F.col("movie_id").alias("title_id"), F.lit(1).alias("tier"))

    names = media_names(media).withColumn("key", text.loosely_normalized(F.col("hint")))
    keyed = titles.withColumns({"a": text.loosely_normalized(F.coalesce("title", F.lit(""))), "b": text.loosely_normalized(F.coalesce("original_title", F.lit("")))})
    forms = keyed.select("title_id", F.col("year").alias("title_year"), F.explode(F.array_distinct(F.array("a", "b"))).alias("key")).filter("key <> ''")
    clean = names.filter(~F.col("hint").rlike(r"[._\[\]()]") & (F.size(F.split("key", " ")) <= 12))
    fits = F.col("year").isNull() | F.col("title_year").isNull() | (F.col("year") == F.col("title_year"))
    order = Window.partitionBy("media_id").orderBy("n", F.asc_nulls_last("title_year"), "title_id")
    exact = clean.join(forms, "key").filter(fits).withColumn("r", F.row_number().over(order)).filter("r = 1").select("media_id", "title_id", F.lit(2).alias("tier"))

    words = keyed.select("title_id", F.explode(F.array_distinct(F.flatten(F.array(F.split("a", " "), F.split("b", " "))))).alias("word")).filter((F.length("word") >= 4) & text.useful_token(F.col("word")))
    order_of_search = Window.partitionBy("word").orderBy("place", "a", F.asc_nulls_first("year"), "title_id")
    begins = F.col("a").startswith(F.col("word")) | F.col("b").startswith(F.col("word"))
    place = F.when((F.col("a") == F.col("word")) | (F.col("b") == F.col("word")), 0).when(begins, 1).otherwise(2)
    found = words.join(keyed, "title_id").withColumn("place", place).withColumn("r", F.row_number().over(order_of_search)).filter(F.col("r") <= CANDIDATES)
    heard = names.select("media_id", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).distinct()
    spoken = names.groupBy("media_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split("key", " ")))).alias("tokens"), F.min_by("year", "n").alias("expected"), F.collect_set("key").alias("keys"))
    candidates = heard.join(found.select("word", "title_id", "title", "original_title", "a", "b", F.col("year").alias("title_year")), "word").join(spoken, "media_id")
    candidates = candidates.filter(F.col("expected").isNull() | (F.col("expected") == F.col("title_year")))
    same = F.coalesce(F.col("expected") == F.col("title_year"), F.lit(False))
    score = text.hint_score(F.col("title"), F.col("original_title"), F.col("word"), F.col("tokens"), same)
    sure = F.col("expected").isNotNull() | F.array_contains("keys", F.col("a")) | F.array_contains("keys", F.col("b"))
    best = candidates.withColumn("score", score).groupBy("media_id").agg(F.min_by(F.struct("title_id", sure.alias("sure")), F.struct(-F.col("score"), "title_id")).alias("x"))
    ranked = best.select("media_id", "x.title_id", F.when(F.col("x.sure"), 3).otherwise(5).alias("tier"))

    aliases = alternates.select("title_id", text.loosely_normalized(F.col("title")).alias("key")).filter("key <> ''").distinct()
    aliases = aliases.join(titles.select("title_id", F.col("year").alias("title_year")), "title_id")
    alias = names.join(aliases, "key").filter(fits).withColumn("r", F.row_number().over(order)).filter("r = 1").select("media_id", "title_id", F.lit(4).alias("tier"))

    every = own.unionByName(exact).unionByName(ranked).unionByName(alias)
    return every.groupBy("media_id").agg(F.min(F.struct("tier", "title_id")).alias("x")).select("media_id", "x.title_id", "x.tier")


def processed_titles(media: DataFrame, scenes: DataFrame, titles: DataFrame, alternates: DataFrame) -> DataFrame:
    """The titles of media that have a scene, each once."""
    live = media.join(scenes.select("media_id").distinct(), "media_id", "left_semi")
    return resolve(live, titles, alternates).select("title_id").distinct()
