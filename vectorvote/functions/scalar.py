"""Scalar functions of the feature vector, as Column expressions in single precision.

Spark divides floats in double precision; casting each quotient back to float gives the single-precision quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import QUANTISED_MAX, QUANTISED_MIN, SCALE

#: RFC 3339 with a mandatory offset.
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def f32(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b).cast("float")


def clamp_unit(x: Column, source: Column | None = None) -> Column:
    """Into [0, 1]; NaN stays.  `source`: a plainer expression that is NaN where x is, so that x is named, and evaluated, once."""
    return F.when(F.isnan(x if source is None else source), f32(float("nan"))).otherwise(clamp(x))


def clamp(x: Column) -> Column:
    """Into [0, 1], for what is never NaN."""
    return F.least(F.greatest(x, f32(0)), f32(1))


def clamp_ratio(value: Column, top: float) -> Column:
    """value / top, clamped; 0 where top isn't positive."""
    return f32(0) if top <= 0 else clamp_unit(divide(f32(value), f32(top)), f32(value))


def amount_vs_average(amount: Column, average: Column, ratio: float) -> Column:
    """(amount / average) / ratio, clamped; without a positive average, 0 for no amount and else 1."""
    a, m = f32(amount), f32(average)
    return F.when(m <= 0, F.when(a <= 0, f32(0)).otherwise(f32(1))).otherwise(clamp_unit(divide(divide(a, m), f32(ratio)), divide(a, m)))


def bool_to_unit(b: Column) -> Column:
    return b.cast("int").cast("float")


def parse_utc(text: Column) -> Column:
    """The instant of an RFC 3339 string, or null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(F.regexp_replace(text, " ", "T"))))


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two instants, truncated, at least 0."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(F.greatest(micros, F.lit(0)) / F.lit(1_000_000)).cast("bigint")


def quantize(x: Column, scale: int = SCALE) -> Column:
    """round(x * scale), half away from zero, clamped to 16 bits; NaN gives 0."""
    scaled = F.round(x.cast("float") * f32(scale))
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.greatest(scaled, f32(QUANTISED_MIN)), f32(QUANTISED_MAX)).cast("int"))


def quantize_array(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: quantize(x, scale))


def l2_squared(a: Column, b: Column, kind: str = "double") -> Column:
    """Squared distance of two arrays, added in their order; kind "bigint" for quantised ones."""
    square = lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0).cast(kind), lambda total, d: total + d)


def l2_within(a: Column, b: Column, most: Column, kind: str = "bigint") -> Column:
    """The squared distance, or null beyond `most`; equality stays."""
    d = l2_squared(a, b, kind)
    return F.when(d <= most, d)
