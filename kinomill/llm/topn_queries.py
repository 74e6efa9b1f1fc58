"""Best scenes of every search and media, and best persons of every scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.llm.topn import top_per_group
from kinomill.tables import table

SCENES, PERSONS = 5, 3


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    scenes = top_per_group(table(spark, folder, "scene_results"), ["search_id", "media_id"], "scene_id", "score", SCENES)
    persons = top_per_group(table(spark, folder, "scene_people"), ["scene_id"], "person_id", "best_score", PERSONS)
    return scenes.select(
        F.lit("scene_results").alias("list_name"),
        F.concat(F.coalesce(F.col("search_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("media_id", F.lit(""))).alias("group_key"),
        F.col("scene_id").alias("item_key"),
    ).unionAll(persons.select(F.lit("scene_people"), "scene_id", "person_id"))


QUERIES = {"p5_found": p5_found}
ORACLES = {
    "p5_found": f"""
        WITH scenes AS (
            SELECT search_id, media_id, scene_id, max(score) AS best FROM scene_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
        persons AS (
            SELECT scene_id, person_id, max(best_score) AS best FROM scene_people WHERE best_score IS NOT NULL AND NOT isnan(best_score) GROUP BY ALL)
        SELECT 'scene_results' AS list_name, coalesce(CAST(search_id AS VARCHAR), '') || '|' || coalesce(media_id, '') AS group_key, scene_id AS item_key FROM scenes
        QUALIFY row_number() OVER (PARTITION BY search_id, media_id ORDER BY best DESC, scene_id ASC NULLS FIRST) <= {SCENES}
        UNION ALL
        SELECT 'scene_people', scene_id, person_id FROM persons
        QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY best DESC, person_id ASC NULLS FIRST) <= {PERSONS}""",
}
