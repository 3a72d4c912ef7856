"""Pages of a sorted table that read only their own part of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values whose order gives the ranges, and ranges.
SAMPLE, RANGES = 4096, 256


def page(df: DataFrame, key: Column, offset: int, limit: int, ties: list[Column] = (), descending: bool = False) -> DataFrame:
    """Rows offset to offset + limit of ``df`` in the order of ``key`` and ``ties``; nulls first, or last if descending.

    Rows are counted in ranges of the key, whose bounds come from a fixed-size sample of its values; only the ranges that
    hold the page are read, by a filter that reaches the scan, and sorted. The counts of RANGES ranges come to the driver.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    kind = df.select(key.alias("k")).schema["k"].dataType
    drawn = df.select(key.alias("k")).where("k IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).distinct().collect()
    values = sorted(r[0] for r in drawn)
    bounds = values[:: max(1, len(values) // RANGES)][1:]
    as_lit = lambda b: F.lit(str(b) if isinstance(b, datetime) else b).cast(kind)
    number = F.when(key.isNull(), -1).otherwise(F.size(F.filter(F.array(*[as_lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0))
    counts = {r[0]: r[1] for r in df.groupBy(number.alias("r")).agg(F.count("*")).collect()}
    before, chosen, skipped = 0, [], None
    for r in sorted(counts, reverse=descending):
        if before < offset + limit and before + counts[r] > offset:
            skipped = before if skipped is None else skipped
            chosen.append(r)
        before += counts[r]
    if not chosen:
        return df.limit(0)
    low, high = min(r for r in chosen), max(r for r in chosen)
    inside = F.lit(True)
    if low > 0:
        inside = key >= as_lit(bounds[low - 1])
    if 0 <= high < len(bounds):
        inside = inside & (key < as_lit(bounds[high]))
    if low == -1:
        inside = key.isNull() if high == -1 else key.isNull() | inside
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return df.where(inside).orderBy(order, *ties).offset(offset - skipped).limit(limit)
