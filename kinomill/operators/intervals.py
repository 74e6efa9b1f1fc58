"""Arithmetic on byte intervals ``[start, end)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinomill.operators.timeline import CELL_ROWS, CELLS

#: Blocks of usual length that a cell is wide, at least.
BLOCKS_OF_A_CELL = 8


def missing(requests: DataFrame, blocks: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """The parts of each request that no block of its key covers: ``request``, ``start``, ``end``.

    Requests and blocks are cut at the edges of cells and meet by key and cell, so neither
    all blocks of a key meet a request nor is a key one window.  In a cell the gaps lie
    between the furthest end so far and the next start; gaps that touch over an edge are
    one; the gaps of a request, not the blocks, are one window.  Empty blocks cover nothing.
    """
    ends = requests.agg(F.min("start").alias("low"), F.max("end").alias("high")).first()
    low, high = (0, 0) if ends["low"] is None else (ends["low"], ends["high"])
    if width is None:
        held = blocks.agg(F.count("*").alias("rows"), F.avg(F.col("end") - F.col("start")).alias("length")).first()
        # wide enough that few blocks lie in more than one cell
        width = max(int(BLOCKS_OF_A_CELL * (held["length"] or 0)), (high - low) // max(CELLS, held["rows"] // CELL_ROWS)) + 1
    size = F.lit(width)

    def cut(rows: DataFrame, low: str, high: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(low) / size), F.greatest(F.floor(F.col(low) / size), F.ceil(F.col(high) / size) - 1))
        return rows.withColumn("_cell", F.explode(cells)).withColumns({low: F.greatest(F.col(low), F.col("_cell") * size), high: F.least(F.col(high), (F.col("_cell") + 1) * size)})

    asked = cut(requests.filter(F.col("start") < F.col("end")).select(key, "request", F.col("start").alias("_a"), F.col("end").alias("_b")), "_a", "_b")
    near = blocks.select(key, F.greatest("start", F.lit(low)).alias("_s"), F.least("end", F.lit(high)).alias("_e")).filter("_s < _e")
    met = asked.join(cut(near, "_s", "_e"), [key, "_cell"])
    clipped = met.filter((F.col("_e") > F.col("_a")) & (F.col("_s") < F.col("_b"))).select(key, "request", "_cell", "_a", F.greatest("_s", "_a").alias("s"), F.least("_e", "_b").alias("e"))
    ends = asked.select(key, "request", "_cell", "_a", F.col("_b").alias("s"), F.col("_b").alias("e"))
    before = Window.partitionBy(key, "request", "_cell").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("e").over(before), F.col("_a"))
    gaps = clipped.unionAll(ends).withColumn("start", reached).filter(F.col("start") < F.col("s")).select(key, "request", "start", F.col("s").alias("end"))
    in_order = Window.partitionBy(key, "request").orderBy("start")
    new = F.when(F.lag("end").over(in_order).eqNullSafe(F.col("start")), 0).otherwise(1)
    numbered = gaps.withColumn("_new", new).withColumn("_gap", F.sum("_new").over(in_order))
    return numbered.groupBy(key, "request", "_gap").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_gap")


def covered(requests: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Each request with the bytes that are there and whether all are."""
    lost = missing(requests, blocks, key).groupBy(key, "request").agg(F.sum(F.col("end") - F.col("start")).alias("lost"))
    rows = requests.join(lost, [key, "request"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return rows.select(key, "request", (F.col("end") - F.col("start") - F.col("lost")).alias("bytes"), (F.col("lost") == 0).alias("complete"))


def insert_clipped(blocks: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old blocks and the parts of new ones that were not covered; new blocks come one at a time for each key."""
    pieces = missing(new, blocks, key).select(key, "start", "end")
    return blocks.select(key, "start", "end").unionByName(pieces)


def kept_by_recency(blocks: DataFrame, key: str, budget: int) -> DataFrame:
    """The most recently used blocks of each key within a budget of bytes; the latest always stays."""
    recent = Window.partitionBy(key).orderBy(F.desc("used"), F.desc("start"))
    total = F.sum("bytes").over(recent.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_total", total).withColumn("_n", F.row_number().over(recent)).filter((F.col("_total") <= budget) | (F.col("_n") == 1)).drop("_total", "_n")
