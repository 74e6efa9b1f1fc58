"""Queries over the raw snapshot lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinomill.operators.rejects import TITLE_BASICS, TITLE_PRINCIPALS, load_lines, reject_lines
from kinomill.tables import table

RAW = (("raw_title_basics", TITLE_BASICS), ("raw_title_principals", TITLE_PRINCIPALS))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = None
    for name, spec in RAW:
        part = reject_lines(table(spark, folder, name), spec).select(F.lit(name).alias("raw_table"), "line_no", "reason")
        found = part if found is None else found.unionByName(part)
    return found


def p2_basics(spark: SparkSession, folder: str) -> DataFrame:
    loaded, _ = load_lines(table(spark, folder, "raw_title_basics"), TITLE_BASICS)
    return loaded.withColumn("genres", F.array_join("genres", "|"))


def p2_principals(spark: SparkSession, folder: str) -> DataFrame:
    loaded, _ = load_lines(table(spark, folder, "raw_title_principals"), TITLE_PRINCIPALS)
    return loaded.withColumn("n_characters", F.coalesce(F.size("characters"), F.lit(0))).withColumn("characters", F.array_join("characters", "|"))


def _json_pattern(depth: int) -> str:
    """JSON nested up to ``depth`` as a pattern without recursion."""
    ws = r"[ \t\r\n]*"
    string = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'
    value = scalar = rf"(?:{string}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
    for _ in range(depth):
        member = rf"{string}{ws}:{ws}{value}"
        value = rf"(?:{scalar}|\[{ws}(?:{value}{ws}(?:,{ws}{value}{ws})*)?\]|\{{{ws}(?:{member}{ws}(?:,{ws}{member}{ws})*)?\}})"
    return f"{ws}{value}{ws}"


def _names_pattern() -> str:
    ws = r"[ \t\r\n]*"
    char = r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})'
    inked = r'(?:[^"\\\x00-\x1f\s\x{a0}\x{3000}]|\\["\\/b]|\\u(?:[1-9a-fA-F][0-9a-fA-F]{3}|0[1-9a-fA-F][0-9a-fA-F]{2}|00[2-9b-fB-F][1-9a-fA-F]))'
    name = f'"{char}*{inked}{char}*"'
    return rf"{ws}\[{ws}{name}{ws}(?:,{ws}{name}{ws})*\]{ws}"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BAD_YEAR = r"NOT (f[{0}] = '\N' OR (regexp_full_match(f[{0}], '[0-9]{{4}}') AND TRY_CAST(f[{0}] AS INT) BETWEEN 1888 AND 2100))"
_FIELDS = "SELECT line_no, string_split(regexp_replace(line, '\\r$', ''), chr(9)) AS f FROM {0}"
_BASICS = rf"""
    SELECT 'raw_title_basics' AS raw_table, line_no, f,
           CASE WHEN f IS NULL OR len(f) <> 9 THEN 1
                WHEN NOT regexp_full_match(f[1], 'tt[0-9]+') OR f[5] NOT IN ('0', '1') OR {_BAD_YEAR.format(6)} OR {_BAD_YEAR.format(7)}
                  OR NOT regexp_full_match(f[8], '\\N|[0-9]{{1,5}}') THEN 3 END AS rank
    FROM ({_FIELDS.format('raw_title_basics')}) WHERE coalesce(f[1], '') <> 'tconst'"""
_PRINCIPALS = rf"""
    SELECT 'raw_title_principals' AS raw_table, line_no, f,
           CASE WHEN f IS NULL OR len(f) <> 6 THEN 1
                WHEN f[6] <> '\N' AND NOT regexp_full_match(f[6], {_quote(_json_pattern(2))}) THEN 2
                WHEN NOT regexp_full_match(f[1], 'tt[0-9]+') OR NOT regexp_full_match(f[2], '0*[1-9][0-9]*') OR NOT regexp_full_match(f[3], 'nm[0-9]+')
                  OR (f[6] <> '\N' AND NOT regexp_full_match(f[6], {_quote(_names_pattern())})) THEN 3 END AS rank
    FROM ({_FIELDS.format('raw_title_principals')}) WHERE coalesce(f[1], '') <> 'tconst'"""

QUERIES = {"p2_found": p2_found, "p2_basics": p2_basics, "p2_principals": p2_principals}
ORACLES = {
    "p2_found": f"""
        SELECT raw_table, line_no, ['column_count', 'broken_quoting', 'invalid_value'][min(rank)] AS reason
        FROM (SELECT raw_table, line_no, rank FROM ({_BASICS}) UNION ALL SELECT raw_table, line_no, rank FROM ({_PRINCIPALS}))
        WHERE rank IS NOT NULL GROUP BY ALL""",
    "p2_basics": rf"""
        SELECT DISTINCT line_no, f[1] AS title_id, nullif(f[2], '\N') AS title_type, nullif(f[3], '\N') AS primary_title, nullif(f[4], '\N') AS original_title,
               f[5] = '1' AS is_adult, TRY_CAST(nullif(f[6], '\N') AS INT) AS start_year, TRY_CAST(nullif(f[7], '\N') AS INT) AS end_year,
               TRY_CAST(nullif(f[8], '\N') AS INT) AS runtime_minutes,
               CASE WHEN f[9] = '\N' THEN '' ELSE replace(f[9], ',', '|') END AS genres
        FROM ({_BASICS}) WHERE rank IS NULL""",
    "p2_principals": rf"""
        SELECT DISTINCT line_no, f[1] AS title_id, CAST(f[2] AS BIGINT) AS ordering, f[3] AS name_id, nullif(f[4], '\N') AS category, nullif(f[5], '\N') AS job,
               array_to_string(CAST(CAST(nullif(f[6], '\N') AS JSON) AS VARCHAR[]), '|') AS characters,
               coalesce(len(CAST(CAST(nullif(f[6], '\N') AS JSON) AS VARCHAR[])), 0)::INT AS n_characters
        FROM ({_PRINCIPALS}) WHERE rank IS NULL""",
}
