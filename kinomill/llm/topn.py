"""The N highest-scoring items of every group, found by descending score bands.

The scores are cut into ranges (bands), narrow at the top and wider further down, and
the bands are processed from the top.  Groups that higher bands have filled are
anti-joined away.  Of each other group the first ``n`` places and :data:`PLACES` times as many of a
band, by score and item, are kept on every partition, and only these are shuffled, once,
by group.  Bands are half-open ranges, so equal scores never fall into two of them and
the band in which a group is filled settles its ties exactly.

An item may take several places of a group with different scores.  Where it takes so
many that a cut group shows fewer than ``n`` items (a clogged group), the items of that
group are brought to one place each before they are cut again.

Groups that hold many rows are nominated by a sketch of bounded size; once filled,
they are dropped while the next bands are scanned, by a broadcast of at most
:data:`HEAVY` keys.  All other filled groups are dropped after the shuffle.

Defined cases:

* null and NaN scores never count; a group with no other score has no row;
* an item that comes several times in a group counts once, with its highest score;
* equal scores are ordered by item, ascending; a null item comes first;
* a null group key is a key like any other;
* columns of the input other than those named are ignored, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinomill.lineage import cut

#: Shares of all rows above each inner edge of the bands.
SHARES = (0.25, 0.5)
#: Groups that may be dropped by broadcast, and the least share of all rows of such a group.
HEAVY, HEAVY_SHARE = 1000, 1e-4
#: Places of a group that are kept on a partition for each item that is wanted, besides its own.
PLACES = 2


#: What stands for null in a group key of a type; a key of another type is put into a struct.
INSTEAD_OF_NULL = {"string": "", "boolean": False, "byte": 0, "short": 0, "integer": 0, "long": 0, "float": 0.0, "double": 0.0, "decimal": 0, "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _never_null(df: DataFrame, group: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """The group keys as columns ``g0``... that are never null with ``nulls``, the bits of those that were; and the way back.

    Keys without nulls are joined by plain equality, so that rows once shuffled by group stay where they are.
    """
    there, back, nulls = [], [], F.lit(0)
    for i, name in enumerate(group):
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        instead = INSTEAD_OF_NULL.get(kind.typeName())
        if instead is None:
            there.append(F.struct(column.alias("key")).alias(f"g{i}"))
            back.append(F.col(f"g{i}.key").alias(name))
        else:
            there.append(F.coalesce(column, F.lit(instead).cast(kind)).alias(f"g{i}"))
            nulls = nulls + F.when(column.isNull(), 1 << i).otherwise(0)
            back.append(F.when(F.col("nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"g{i}")).alias(name))
    return [*there, nulls.alias("nulls")], back


def top_per_group(df: DataFrame, group: Sequence[str], item: str, score: str, n: int, shares: Sequence[float] = SHARES) -> DataFrame:
    """``(*group, item, score, rank)`` with ``rank`` from 1 to at most ``n``."""
    there, back = _never_null(df, group)
    keys = [*(f"g{i}" for i in range(len(group))), "nulls"]
    usable = df.select(*there, F.col(f"`{item}`").alias("item"), F.col(f"`{score}`").cast("double").alias("score"))
    usable = usable.filter(F.col("score").isNotNull() & ~F.isnan("score"))

    stats = usable.agg(
        F.count("*").alias("rows"),
        F.percentile_approx("score", [1 - s for s in shares], 1000).alias("edges"),
        F.expr(f"approx_top_k(xxhash64({', '.join(keys)}), {HEAVY}, {10 * HEAVY})").alias("heavy"),
    ).first()
    heavy = [x["item"] for x in stats["heavy"] or [] if x["count"] >= stats["rows"] * HEAVY_SHARE]
    edges = sorted(set(stats["edges"] or []), reverse=True)

    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("item"))
    whole = Window.partitionBy(*keys)
    places = (PLACES + 1) * n
    done: list[DataFrame] = []
    open_rows: DataFrame | None = None
    for upper, lower in zip([None, *edges], [*edges, None], strict=True):
        band = usable
        if upper is not None:
            band = band.filter(F.col("score") < upper)
        if lower is not None:
            band = band.filter(F.col("score") >= lower)
        filled = reduce(DataFrame.unionAll, (d.filter("filled AND rank = 1").select(keys) for d in done)) if done else None
        if filled is not None and heavy:
            known = filled.filter(F.xxhash64(*keys).isin(heavy))
            band = band.join(F.broadcast(known), keys, "left_anti")
        if open_rows is not None:  # what higher bands found of groups they did not fill takes the first places, less than n
            band = band.unionByName(open_rows)
        # equal rows share a place, so a partition keeps the first places of a group however often they come
        first = band.withColumn("place", F.dense_rank().over(best)).filter(F.col("place") <= places)
        if filled is not None:
            first = first.join(filled, keys, "left_anti")
        found = first.groupBy(*keys, "item").agg(F.max("score").alias("score"), F.max("place").alias("place"))
        ranked = found.withColumn("rank", F.row_number().over(best)).withColumns({"items": F.count("*").over(whole), "places": F.max("place").over(whole)})
        ranked = cut(ranked.filter(F.col("rank") <= n).select(*keys, "item", "score", "rank", (F.col("items") >= n).alias("filled"), (F.col("places") >= places).alias("full")))
        clogged = ranked.filter("full AND NOT filled").select(keys).distinct()
        if not clogged.isEmpty():
            every = band.join(clogged, keys, "left_semi").groupBy(*keys, "item").agg(F.max("score").alias("score"))
            every = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).withColumn("filled", F.count("*").over(whole) >= n)
            ranked = cut(ranked.filter("filled OR NOT full").drop("full").unionByName(every))
        else:
            ranked = ranked.drop("full")
        open_rows = ranked.filter("NOT filled").select(*keys, "item", "score")
        done = [*(d.filter("filled") for d in done), ranked]
    return reduce(DataFrame.unionAll, (d.select(*back, F.col("item").alias(item), F.col("score").alias(score), "rank") for d in done))
