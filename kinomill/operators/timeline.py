"""Joins and windows over time series: as-of, ranges, islands, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells into which the times of a table are cut at least, and rows of a table for each of them: so that a key of many rows is no single window.
CELLS, CELL_ROWS = 16, 1_000_000


def cell_width(rows: DataFrame, time: str) -> float:
    """The width of cells over all times of ``rows``, more cells the more rows there are; 1 if there is but one time."""
    ends = rows.agg((F.max(time).cast("double") - F.min(time).cast("double")).alias("span"), F.count("*").alias("rows")).first()
    return (ends["span"] or 0.0) / max(CELLS, ends["rows"] // CELL_ROWS) or 1.0


def _before(cells: DataFrame, key: str, value: Column) -> DataFrame:
    """``cells`` (a row for each key and ``_cell``) with ``_carried``, the aggregate ``value`` of the cells before it."""
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(key, "_cell", value.over(earlier).alias("_carried"))


def as_of(probes: DataFrame, series: DataFrame, key: str, time: str, value: str, first_if_none: bool = True, width: float | None = None) -> DataFrame:
    """Adds to each probe the last ``value`` of the series at or before its time; before the first, the first one if asked for.

    Both sides are sorted together within a key's cells of time; each cell hands its last
    value to the ones after it, so a key with many rows is many windows, and no probe is paired
    with more than one row.  Of several rows of one time the largest value counts.
    """
    rows = series.select(key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_s")).withColumn("_p", F.lit(None).cast(probes.schema.simpleString()))
    asked = probes.select(key, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), F.struct(*probes.columns).alias("_p"))
    cell = F.floor(F.col("_t").cast("double") / F.lit(cell_width(series, time) if width is None else width))
    both = rows.select(*asked.columns).unionAll(asked).withColumn("_cell", cell)
    lasts = both.groupBy(key, "_cell").agg(F.max(F.when(F.col("_side") == 0, F.col("_s"))).alias("_latest"))
    carried = _before(lasts, key, F.last("_latest", ignorenulls=True))
    order = Window.partitionBy(key, "_cell").orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_s", ignorenulls=True).over(order)).filter("_side = 1").join(carried, [key, "_cell"], "left")
    last = F.coalesce("_last", "_carried")
    if first_if_none:
        filled = filled.join(rows.groupBy(key).agg(F.min("_s").alias("_first")), key, "left")
        last = F.coalesce(last, "_first")
    return filled.select("_p.*", last["v"].alias(value))


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, width: float) -> DataFrame:
    """Points joined to the ranges ``[start, end)`` of their key that hold them, by cells of ``width`` instead of a comparison of all pairs."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    placed = points.withColumn("_cell", F.floor(F.col("t") / width))
    return placed.join(cells, [key, "_cell"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("_cell")


def islands(spans: DataFrame, key: str, gap: float, width: float | None = None) -> DataFrame:
    """Spans of a key merged where one starts at most ``gap`` after the latest end so far.

    A key's spans are handled in cells of their starts; each cell hands its latest end and its
    number of islands to the ones after it.
    """
    placed = spans.withColumn("_cell", F.floor(F.col("start").cast("double") / F.lit(cell_width(spans, "start") if width is None else width)))
    ends = _before(placed.groupBy(key, "_cell").agg(F.max("end").alias("_end")), key, F.max("_end"))
    before = Window.partitionBy(key, "_cell").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key, "_cell").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.greatest(F.max("end").over(before), F.col("_carried"))  # nulls do not count
    marked = placed.join(ends, [key, "_cell"]).withColumn("_new", F.when(latest.isNull() | (F.col("start") > latest + gap), 1).otherwise(0)).drop("_carried")
    counts = _before(marked.groupBy(key, "_cell").agg(F.sum("_new").alias("_sum")), key, F.sum("_sum"))
    numbered = marked.join(counts, [key, "_cell"]).withColumn("_island", F.coalesce("_carried", F.lit(0)) + F.sum("_new").over(upto))
    return numbered.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def refinement_windows(candidates: DataFrame, key: str, back: float = 10.0, ahead: float = 1.0, gap: float = 0.25) -> DataFrame:
    """The spans to look at again around candidate boundaries ``t`` of a timeline of ``duration``."""
    inside = candidates.filter((F.col("t") > 0.25) & (F.col("t") < F.col("duration") - 0.05))
    spans = inside.select(key, F.greatest(F.lit(0.0), F.col("t") - back).alias("start"), F.least(F.col("duration"), F.col("t") + ahead).alias("end"))
    return islands(spans, key, gap)


def decode_times(runs: DataFrame, key: str, order: str, scale: Column) -> DataFrame:
    """Runs of ``count`` samples ``delta`` apart get ``first`` (samples before) and ``base`` (seconds before)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    first = F.coalesce(F.sum("count").over(before), zero)
    base = F.coalesce(F.sum(F.col("count") * F.col("delta")).over(before), zero)
    return runs.withColumns({"first": first, "base": base / scale})
