"""Numbers and years written as text, scores and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(x: Column, dtype: str = "int") -> Column:
    """The number if the text is a sign and digits and nothing else, else null."""
    return F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast(dtype))


def positive_year(x: Column) -> Column:
    number = whole_number(x)
    return F.when(number > 0, number)


def count_or_zero(x: Column, dtype: str = "int") -> Column:
    """0 for what is no number and for negative numbers."""
    return F.greatest(F.coalesce(whole_number(x, dtype), F.lit(0).cast(dtype)), F.lit(0).cast(dtype))


def decimal_or_zero(x: Column) -> Column:
    number = F.when(x.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), x.try_cast("float"))
    return F.greatest(F.coalesce(number, F.lit(0).cast("float")), F.lit(0).cast("float"))


def year_of_date(x: Column) -> Column:
    return whole_number(F.when(F.length(x) >= 4, F.substring(x, 1, 4)))


def rounded_score(x: Column) -> Column:
    """Six decimals, halves away from zero, in single precision."""
    return F.round(x.cast("double"), 6).cast("float")


def json_integer(x: Column, path: str) -> Column:
    """A number of a JSON text as an integer, 0 for anything else."""
    raw = F.get_json_object(x, path)
    return F.coalesce(F.when(raw.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), raw.try_cast("double")).try_cast("int"), F.lit(0))


def json_flag(x: Column, key: str) -> Column:
    """Whether a member of a JSON object is the value true (not a text of it)."""
    member = F.try_variant_get(F.try_parse_json(x), f"$.{key}", "variant")
    return F.coalesce((F.schema_of_variant(member) == "BOOLEAN") & F.try_variant_get(F.try_parse_json(x), f"$.{key}", "boolean"), F.lit(False))


def fitted_size(width: Column, height: Column, most_wide: Column, most_high: Column) -> Column:
    """Width and height that fit into the bounds with the same proportions; a bound of 0 is none, nothing is enlarged."""

    def ratio(bound: Column, size: Column) -> Column:
        return F.when((bound > 0) & (bound < size), bound.cast("double") / size).otherwise(1.0)

    scale = F.least(ratio(most_wide, width), ratio(most_high, height))
    fit = [F.when((scale >= 1) | (width < 1) | (height < 1), s).otherwise(F.greatest(F.lit(1), F.round(s * scale).cast("int"))) for s in (width, height)]
    return F.struct(fit[0].alias("width"), fit[1].alias("height"))


def face_quality(detection: Column, left: Column, top: Column, right: Column, bottom: Column, frame_area: Column) -> Column:
    """Detection score lowered for faces that fill little of the frame."""
    zero, one = F.lit(0.0), F.lit(1.0)
    area = F.greatest(zero, right - left) * F.greatest(zero, bottom - top)
    return F.greatest(zero, F.least(one, detection * F.least(one, F.sqrt(area / F.greatest(one, frame_area)) / 0.25)))
