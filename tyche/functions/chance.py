"""Scalar expressions of uncertain graphs: coins, sample sizes, probabilities, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) with 52 random bits that depends on ``key`` alone, not on partitions or order."""
    text = F.concat_ws("|", *(k if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def fast_uniform(*key: Column | str | int) -> Column:
    """As :func:`uniform` from a 64-bit hash: several times cheaper, for very many worlds."""
    return F.shiftrightunsigned(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key)), 12) / float(1 << 52)


def sample_count(p: float, epsilon: float = 0.1, delta: float = 0.01, fraction: float = 0.1) -> int:
    """Worlds that estimate probabilities of at least ``p`` within a factor ``1 ± epsilon`` but for a chance ``delta``."""
    return int(fraction / (epsilon * epsilon * p) * math.log(1 / delta))


def sample_count_column(p: Column, epsilon: float = 0.1, delta: float = 0.01, fraction: float = 0.1) -> Column:
    return F.floor(F.lit(fraction) / (F.lit(epsilon * epsilon) * p) * F.lit(math.log(1 / delta))).cast("long")


def cooccurrence_probability(count: Column) -> Column:
    """``1 - e^(-count / 2)``."""
    return 1 - F.exp(-0.5 * count)


def edge_weight(p: Column) -> Column:
    """``ln(1 / p)``, infinite for 0."""
    return F.when(p > 0, -F.ln(p)).otherwise(F.lit(float("inf")))


def to_thousandths(value: Column) -> Column:
    """Three decimals, halves away from zero, by the same arithmetic as the engines that scale and round."""
    return F.round(value * 1000) / 1000


def format_point(value: Column) -> Column:
    """Three decimals without the leading zero, in math mode; ``< 10^{-3}`` for 0."""
    shown = F.substring(F.format_string("%.3f", to_thousandths(value)), 2, 100)
    return F.when(value == 0, "$< 10^{-3}$").otherwise(F.concat(F.lit("$"), shown, F.lit("$")))


@F.udf(StringType())
def scientific(value: float | None) -> str | None:
    """Four digits and an exponent as C prints them: halves go to the even digit, where Spark's formats round them up."""
    return None if value is None else f"{value:.3E}"


def format_exponent(value: Column) -> Column:
    """Three decimals and a power of ten, in math mode."""
    return F.concat(F.lit("$"), F.replace(scientific(to_thousandths(value)), F.lit("E"), F.lit(r"\cdot 10^{")), F.lit("}$"))
