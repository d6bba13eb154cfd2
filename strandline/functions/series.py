"""Expressions on values and context arrays."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.config import PATCH


def known(value: Column) -> Column:
    """The value, or null where it is missing (null, NaN) or not finite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def normalize_ticker(name: Column) -> Column:
    """Upper case without white space at either end."""
    return F.upper(F.regexp_replace(name, r"^\s+|\s+$", ""))


def rounded_context(length: Column) -> Column:
    return (F.ceil(length / F.lit(float(PATCH))) * PATCH).cast("bigint")


def edge_pad(values: Column, n: int) -> Column:
    """The last n values; a shorter array is filled up on the left with its first value."""
    fill = F.array_repeat(values[0], F.greatest(F.lit(0), F.lit(n) - F.size(values)))
    return F.when(F.size(values) > 0, F.slice(F.concat(fill, values), -n, n))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def stddev_pop_of(values: Column) -> Column:
    """Population standard deviation, in two passes."""
    def of(m: Column) -> Column:
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values))

    return F.transform(F.array(mean_of(values)), of)[0]


def hashed_normal(*key: Column) -> Column:
    """A standard normal draw fixed by the key, so no partitioning changes it (Box-Muller)."""
    def uniform(tag: str) -> Column:
        text = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(tag))
        return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)

    return F.sqrt(-2.0 * F.log(uniform("a"))) * F.cos(F.lit(6.283185307179586) * uniform("b"))


def drawn_normal(*key: object) -> float:
    """`hashed_normal` of one key, in Python."""
    def uniform(tag: str) -> float:
        text = "|".join([*(str(k) for k in key), tag])
        return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    return math.sqrt(-2.0 * math.log(uniform("a"))) * math.cos(6.283185307179586 * uniform("b"))
