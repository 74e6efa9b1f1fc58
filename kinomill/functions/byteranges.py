"""Byte ranges of HTTP headers, chunk grids and container bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def http_range(header: Column, size: Column) -> Column:
    """``start``, ``end`` and ``status`` (200 whole, 206 part) of one range of a file of ``size`` bytes; null fields and 416 where it cannot be served."""
    text = F.trim(F.coalesce(header, F.lit("")))
    spec = F.trim(F.substring(text, 7, 2**31 - 1))
    whole = ~F.lower(text).startswith("bytes=")
    suffix = F.regexp_extract(spec, r"^-\+?([0-9]+)$", 1).try_cast("long")
    first = F.regexp_extract(spec, r"^\+?([0-9]+)-\s*(?:\+?[0-9]+)?$", 1).try_cast("long")
    last = F.regexp_extract(spec, r"^\+?[0-9]+-\s*\+?([0-9]+)$", 1)
    end = F.when(last == "", size - 1).otherwise(F.least(last.try_cast("long"), size - 1))
    given = F.when(last == "", size - 1).otherwise(last.try_cast("long"))
    none = F.lit(None).cast("long")
    answer = (
        F.when(whole, F.struct(F.lit(0).cast("long").alias("start"), (size - 1).alias("end"), F.lit(200).alias("status")))
        .when(suffix > 0, F.struct((size - F.least(suffix, size)).alias("start"), (size - 1).alias("end"), F.lit(206).alias("status")))
        .when((first < size) & (given >= first), F.struct(first.alias("start"), end.alias("end"), F.lit(206).alias("status")))
    )
    return F.coalesce(answer, F.struct(none.alias("start"), none.alias("end"), F.lit(416).alias("status")))


def aligned_span(start: Column, end: Column, chunk: int, size: Column, sequential: Column) -> Column:
    """The span widened to whole chunks; short spans of random reads stay as they are."""
    low = F.floor(start / chunk) * chunk
    high = F.floor(end / chunk) * chunk + chunk - 1
    high = F.when((size > 0) & (high >= size), size - 1).otherwise(high)
    keep = (~sequential & ((end - start + 1) * 2 < chunk)) | (high < end)
    return F.struct(F.when(keep, start).otherwise(low).alias("start"), F.when(keep, end).otherwise(high).alias("end"))


def block_length(index: Column, size: Column, block: int) -> Column:
    return F.least(F.lit(block).cast("long"), size - index * block)


def container_kind(header: Column) -> Column:
    """``mp4``, ``matroska`` or null, by the first bytes."""
    return F.when(F.substring(header, 5, 4) == F.lit(b"ftyp"), "mp4").when(F.substring(header, 1, 4) == F.lit(bytes([0x1A, 0x45, 0xDF, 0xA3])), "matroska")
