"""Null-safe number handling and right-closed binning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and the infinities; every source passes its doubles through here."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def number(text: Column | str) -> Column:
    """Text to a finite DOUBLE, NULL when it is not one."""
    return finite(col(text).try_cast("double"))


def clamp(c: Column | str, low: float = 0.0, high: float = 100.0) -> Column:
    """``c`` held within [low, high]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def truthy(c: Column | str) -> Column:
    """Boolean, number or text flag to BOOLEAN; NULL and unknown words are false."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(word.isin("true", "1", "1.0", "yes"), F.lit(False))


def bin_index(c: Column | str, edges: tuple, include_lowest: bool = False) -> Column:
    """Index of the (low, high] bin; NULL outside the edges. ``None`` marks an open end."""
    c = col(c)
    low, high = edges[0], edges[-1]
    inside = F.lit(True)
    if low is not None:
        inside = inside & ((c >= low) if include_lowest else (c > low))
    if high is not None:
        inside = inside & (c <= high)
    inner = edges[1:-1]
    steps = reduce(lambda chain, step: chain.when(c <= step[1], step[0]), enumerate(inner), F)
    return F.when(c.isNotNull() & inside, steps.otherwise(len(inner))).cast("long")


def bin_label(c: Column | str, edges: tuple, include_lowest: bool = False) -> Column:
    """Interval text such as ``(20, 50]``; 'none' outside the edges."""
    names = [
        f"({'-inf' if a is None else a}, {'inf' if b is None else b}]"
        for a, b in zip(edges[:-1], edges[1:])
    ]
    return pick(bin_index(c, edges, include_lowest), names, "none")


def pick(index: Column, values, default) -> Column:
    """values[index] as a CASE chain, ``default`` for NULL."""
    chain = reduce(lambda acc, item: acc.when(index == item[0], F.lit(item[1])), enumerate(values), F)
    return chain.otherwise(F.lit(default))
