"""Loading delimited lines while setting failing ones apart with a reason.

A line is checked in two ways.  Its structure (the number of fields) is checked on
the line.  Its values are checked by value: every distinct value of a checked column
is tried once, the values that fail form a dictionary with their reasons, and the
dictionary is joined back to the cells.  The join is salted by line, so that one
value in a third of all lines is spread over many tasks.

Defined cases:

* a null line has no fields and fails with ``column_count``; so does an empty line;
* header lines (first field equal to ``spec.header``) are neither loaded nor rejected;
* a carriage return at the end of a line belongs to the line end;
* a line number that comes several times counts once; its reason is the first that
  applies to any of its lines;
* columns of the input other than the key and the line are ignored, whatever their names;
* an empty table gives two empty results with the same schemas.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_COUNT, BROKEN_QUOTING, INVALID_VALUE = REASONS = ("column_count", "broken_quoting", "invalid_value")
MISSING = "\\N"
SALTS = 16


@dataclass(frozen=True)
class Field:
    """``check`` maps a column of values to null where they are right, else to the reason.  ``cast`` gives the typed value."""

    position: int
    name: str
    cast: Callable[[Column], Column]
    check: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class LineSpec:
    width: int
    fields: tuple[Field, ...]
    header: str = "tconst"
    separator: str = "\t"


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda v: F.when(~v.rlike(rf"\A(?:{pattern})\z"), F.lit(INVALID_VALUE))


def _year(v: Column) -> Column:
    digits = v.rlike(r"\A[0-9]{4}\z")
    return F.when((v != MISSING) & ~(digits & F.when(digits, v.cast("int").between(1888, 2100)).otherwise(False)), F.lit(INVALID_VALUE))


def is_strict_json(text: str) -> bool:
    """Whether ``text`` is one JSON value by RFC 8259; of any depth, since nothing recurses."""

    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
        return True
    except RecursionError:
        return _balanced_json(text)
    except ValueError:
        return False


def _balanced_json(text: str) -> bool:
    """For values too deep for the parser: innermost containers are checked and replaced by a null until one value is left."""
    scalar = r'(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)'
    ws = r"[ \t\r\n]*"
    text = re.sub(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', '""', text)
    inner = re.compile(rf'\[{ws}(?:{scalar}{ws}(?:,{ws}{scalar}{ws})*)?\]|\{{{ws}(?:""{ws}:{ws}{scalar}{ws}(?:,{ws}""{ws}:{ws}{scalar}{ws})*)?\}}', re.ASCII)
    changed = 1
    while changed:
        text, changed = inner.subn("null", text)
    return re.fullmatch(rf"{ws}{scalar}{ws}", text, re.ASCII) is not None


def json_names_reason(value: str | None) -> str | None:
    """None for a missing value and for a non-empty JSON list of non-blank strings."""
    if value is None or value == MISSING:
        return None
    if not is_strict_json(value):
        return BROKEN_QUOTING
    try:
        names = json.loads(value, parse_int=lambda _: None, parse_float=lambda _: None)
    except RecursionError:
        return INVALID_VALUE
    return None if isinstance(names, list) and names and all(isinstance(x, str) and x.strip() for x in names) else INVALID_VALUE


def _json_names_reasons(values: Column) -> Column:
    def reasons(batch: pd.Series) -> pd.Series:
        return batch.map(json_names_reason)

    return F.pandas_udf(reasons, T.StringType())(values)


def _or_missing(dtype: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v != MISSING, v).try_cast(dtype)


def _text(v: Column) -> Column:
    return F.when(v != MISSING, v)


TITLE_BASICS = LineSpec(
    9,
    (
        Field(1, "title_id", _text, _matches("tt[0-9]+")),
        Field(2, "title_type", _text),
        Field(3, "primary_title", _text),
        Field(4, "original_title", _text),
        Field(5, "is_adult", lambda v: v == "1", _matches("[01]")),
        Field(6, "start_year", _or_missing("int"), _year),
        Field(7, "end_year", _or_missing("int"), _year),
        Field(8, "runtime_minutes", _or_missing("int"), _matches(r"\\N|[0-9]{1,5}")),
        Field(9, "genres", lambda v: F.when((v == MISSING) | (v == ""), F.array().cast("array<string>")).otherwise(F.split(v, ","))),
    ),
)

TITLE_PRINCIPALS = LineSpec(
    6,
    (
        Field(1, "title_id", _text, _matches("tt[0-9]+")),
        Field(2, "ordering", _or_missing("bigint"), _matches("0*[1-9][0-9]*")),
        Field(3, "name_id", _text, _matches("nm[0-9]+")),
        Field(4, "category", _text),
        Field(5, "job", _text),
        Field(6, "characters", lambda v: F.from_json(_text(v), "array<string>"), _json_names_reasons),
    ),
)


def _rows(df: DataFrame, spec: LineSpec, key: str, line: str) -> DataFrame:
    """Key and fields of every line but headers."""
    text = F.regexp_replace(F.col(f"`{line}`"), r"\r\z", "")
    fields = F.coalesce(F.split(text, spec.separator, -1), F.array().cast("array<string>"))
    rows = df.select(F.col(f"`{key}`").alias("key"), fields.alias("fields"))
    return rows.filter(F.coalesce(F.get("fields", F.lit(0)) != spec.header, F.lit(True)))


def _rank(reason: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, REASONS)), reason)


def reject_lines(df: DataFrame, spec: LineSpec, key: str = "line_no", line: str = "line") -> DataFrame:
    """``(key, reason)``: one row for each failing line, with the first reason of :data:`REASONS` that applies."""
    rows = _rows(df, spec, key, line)
    wrong = rows.filter(F.size("fields") != spec.width).select("key", F.lit(1).cast("long").alias("rank"))

    checked = [f for f in spec.fields if f.check]
    cell = F.array(*(F.struct(F.lit(f.position).alias("position"), F.get("fields", F.lit(f.position - 1)).alias("value")) for f in checked))
    cells = rows.filter(F.size("fields") == spec.width).select("key", F.inline(cell))

    # each different value of a column is tried once, all columns in one pass; a check sees null in place of values of other columns
    verdict = F.lit(None).cast("string")
    for f in checked:
        here = F.col("position") == f.position
        verdict = F.when(here, f.check(F.when(here, F.col("value")))).otherwise(verdict)
    invalid = cells.distinct().select("position", "value", verdict.alias("reason"))
    invalid = invalid.filter("reason IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    salted = cells.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    bad = salted.join(invalid, ["position", "value", "salt"]).select("key", _rank(F.col("reason")).alias("rank"))
    first = wrong.unionByName(bad).groupBy("key").agg(F.min("rank").alias("rank"))
    return first.select(F.col("key").alias(key), F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank").cast("int")).alias("reason"))


def load_lines(df: DataFrame, spec: LineSpec, key: str = "line_no", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """The valid lines with typed columns, one row a key, and the rejects of :func:`reject_lines`."""
    rejects = reject_lines(df, spec, key, line)
    rows = _rows(df, spec, key, line).join(rejects.select(F.col(key).alias("key")), "key", "left_anti").dropDuplicates(["key"])
    typed = rows.select(F.col("key").alias(key), *(f.cast(F.get("fields", F.lit(f.position - 1))).alias(f.name) for f in spec.fields))
    return typed, rejects
