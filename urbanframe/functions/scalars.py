"""Scalar column helpers shared by the layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Scaled values up to here are rounded as doubles, if they are further from a half than fifteen digits can move them.
_PLAIN, _HALF = 1e8, 1e-5


def round_numeric(v, digits: int) -> Column:
    """Round half away from zero on the fifteen decimal digits a double is sure of, as a cast to numeric takes them.

    The digits are written out only where they can decide: near a half, and for large values.
    """
    v = F.col(v) if isinstance(v, str) else v
    scale = F.lit(10.0**digits)

    def rounded(x: Column) -> Column:
        scaled = x * scale
        plain = (F.abs(scaled) < _PLAIN) & (F.abs(scaled - F.floor(scaled) - 0.5) > _HALF)
        # a null or NaN has no such digits and stays null
        digit_wise = F.round(F.format_string("%.14e", x).try_cast("decimal(38,18)"), digits).cast("double")
        return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(digit_wise)

    # an array of one, so that the value itself is computed once
    return F.transform(F.array(v.cast("double")), rounded)[0]


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def height_category(height: Column) -> Column:
    # Fixed class bounds in metres and labels.
    return (
        F.when(height >= 40, "muy_alto").when(height >= 25, "alto").when(height >= 12, "medio").otherwise("bajo")
    )


def graded(value: Column, steps: list[tuple[float, str]], default: str, strict: bool = True) -> Column:
    """First label whose bound the value exceeds (or reaches); null goes to the default."""
    out = None
    for bound, label in steps:
        test = value > bound if strict else value >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def below(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    out = None
    for bound, label in steps:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(default)


STOREY_HEIGHT_M = 3.2


def estimated_floors(height: Column) -> Column:
    """At least one floor, one per 3.2 m (half rounds up)."""
    return F.greatest(F.lit(1), F.round((height / STOREY_HEIGHT_M).cast("double")).cast("int"))


def count_if(cond: Column) -> Column:
    """Rows where the condition is true (null counts as false)."""
    return F.count_if(cond)


def concat_nulls_empty(*cols) -> Column:
    return F.concat_ws("", *cols)


def number_text(v: Column) -> Column:
    """Double as text, without a trailing ``.0`` for whole numbers."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def hex_byte(v: Column) -> Column:
    """Scaled channel as lower-case hex, not padded (1.0 gives ``100``)."""
    return F.lower(F.hex(F.round((v * 256).cast("double")).cast("int")))


def one_or_null(v: Column) -> Column:
    """One-element array, null when the element is null."""
    return F.when(v.isNotNull(), F.array(v))


def json_or_null(*fields: Column) -> Column:
    """JSON object without null members; null when nothing is left."""
    return F.nullif(F.to_json(F.struct(*fields)), F.lit("{}"))
