"""Scene boundaries, segments and sampling, as expressions over arrays of seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinomill.functions.binding import bind_list

#: Seconds at the ends in which no boundary counts, and the least distance of two.
HEAD, TAIL, APART = 0.25, 0.05, 0.5
LOOK_BACK, LOOK_AHEAD, JOIN = 10.0, 1.0, 0.25
SAMPLE_INTERVAL, FAST_SCENES, KEYFRAME_SCENES = 30.0, 32, 240


def is_boundary(t: Column, duration: Column) -> Column:
    return (t > HEAD) & (t < duration - TAIL)


def spaced_boundaries(times: Column, duration: Column) -> Column:
    """Sorted boundaries, each at least :data:`APART` after the last that was kept."""
    inside = F.array_sort(F.filter(times, lambda t: is_boundary(t, duration)))
    return F.aggregate(
        inside,
        F.array().cast("array<double>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.get(kept, F.size(kept) - 1) >= APART), F.concat(kept, F.array(t))).otherwise(kept),
    )


def scene_intervals(boundaries: Column, duration: Column) -> Column:
    """``start`` and ``end`` of the scenes that begin at 0 and at each boundary more than :data:`APART` after the last start."""
    starts = F.aggregate(
        boundaries,
        F.array(F.lit(0.0)),
        lambda s, t: F.when((t > F.get(s, F.size(s) - 1) + APART) & (t < duration - TAIL), F.concat(s, F.array(t))).otherwise(s),
    )
    scenes = bind_list(starts, lambda all_: F.transform(all_, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(all_, i + 1), duration).alias("end"))))
    return F.filter(scenes, lambda x: x["end"] > x["start"])


def first_scenes(boundaries: Column, most: int) -> Column:
    """At most ``most`` scenes' boundaries: the first ``most - 1``."""
    return F.slice(boundaries, 1, max(most - 1, 0))


def sample_interval(interval: Column) -> Column:
    return F.when(interval > 0, interval).otherwise(SAMPLE_INTERVAL)


def scene_limit(limit: Column, default: int) -> Column:
    return F.when(limit > 0, limit).otherwise(default)


def even_boundaries(duration: Column, interval: Column, most: Column) -> Column:
    """Boundaries of scenes of equal length, about an interval long, of which there are at most ``most`` (0: any number)."""
    n = F.greatest(F.ceil(duration / sample_interval(interval)).cast("int"), F.lit(1))
    n = F.when((most > 0) & (n > most), most).otherwise(n).cast("int")
    step = duration / n
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: step * i)
    return F.when((duration > 0) & (n > 1), some).otherwise(F.array().cast("array<double>"))


def candidate_threshold(threshold: Column) -> Column:
    return F.least(F.greatest(threshold * 0.3, F.lit(0.08)), F.lit(0.2))


def segments(duration: Column, parts: Column, overlap: Column) -> Column:
    """Equal parts of a timeline, each with the wider span to decode for it."""
    overlap = F.greatest(overlap, F.lit(0.0))

    def one(i: Column) -> Column:
        start, end = duration * i / parts, duration * (i + 1) / parts
        return F.struct(
            i.alias("index"),
            start.alias("start"),
            end.alias("end"),
            F.when(i > 0, F.greatest(F.lit(0.0), start - overlap)).otherwise(start).alias("decode_start"),
            F.when(i + 1 < parts, F.least(duration, end + overlap)).otherwise(end).alias("decode_end"),
        )

    return F.when((duration > 0) & (parts > 0), F.transform(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))), one))


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def sync_samples(entries: Column, samples: Column) -> Column:
    """Sorted numbers of the samples that can be entered: those listed, or all where there is no list."""
    return F.when(entries.isNull(), F.sequence(F.lit(1), samples)).otherwise(F.array_sort(F.filter(entries, lambda e: (e >= 1) & (e <= samples))))
