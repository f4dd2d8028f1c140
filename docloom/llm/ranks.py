"""Exact ranks within groups from hierarchical digit histograms, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import discard, materialize

BITS = 10  # bits of a digit: a histogram's parent has 1024 children at most
LIMIT = 8192  # rows of a bucket that one task sorts


def ranked(rows: DataFrame, group: str, digits: list[str], order: list[str], limit: int = LIMIT) -> DataFrame:
    """rows with ``rank`` (long, from 0 in each group, by ``order``) and ``size`` (rows of the group).

    ``digits``: columns of non-null longs whose lexical order agrees with ``order`` (they may
    tie where it goes on); ``group`` isn't null. ``rows`` is read several times, so it
    should be a written table. Buckets are the longest digit prefixes of a level; the level
    is the coarsest whose buckets have ``limit`` rows at most. Histograms of coarser levels
    are sums of finer ones, and a bucket's first rank is the sum of what lies before it at
    each level. Only a bucket that all digits leave too large is sorted as it is.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(digits[0]).alias("low"), F.max(digits[0]).alias("high")).first()
    if not seen.n:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
    spread = (seen.high - seen.low).bit_length()
    level = (0, max(0, spread - max(0, (4 * seen.n // limit).bit_length())))
    while True:
        at, shift = level
        keys = digits[: at + 1]
        own = [*(F.col(c) for c in digits[:at]), F.shiftright(digits[at], min(shift, 63))]
        hist = materialize(rows.groupBy(group, *(c.alias(k) for c, k in zip(own, keys, strict=True))).agg(F.count(F.lit(1)).alias("n")), "histogram")
        if level == (len(digits) - 1, 0) or hist.agg(F.max("n")).first()[0] <= limit:
            break
        discard(hist)
        level = (at, max(0, shift - BITS)) if shift else (at + 1, 64 - BITS)
    tables = [hist]  # finest first
    while at or shift < 64:
        shift += BITS
        if shift >= 64 and at:
            at, shift, up = at - 1, 0, [F.col(c) for c in keys[:-1]]
            keys = keys[:-1]
        elif shift >= 64 or not at and seen.high >> shift == seen.low >> shift:
            break
        else:
            up = [*(F.col(c) for c in keys[:-1]), F.shiftright(keys[-1], BITS)]
        tables.append(materialize(tables[-1].groupBy(group, *(c.alias(k) for c, k in zip(up, keys, strict=True))).agg(F.sum("n").alias("n")), "histogram"))
    # Down again: what lies before a bucket among its siblings, and before its parent.
    top = tables.pop()
    keys = [c for c in digits if c in top.columns]
    behind = Window.partitionBy(group).orderBy(*keys)
    base = top.withColumn("first", F.coalesce(F.sum("n").over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy(group)))
    while tables:
        child = tables.pop()
        own = [c for c in digits if c in child.columns]
        above = [f"up_{c}" for c in keys]
        if len(own) > len(keys):
            child = child.withColumns({f"up_{c}": F.col(c) for c in keys})
        else:
            child = child.withColumns({f"up_{c}": F.col(c) for c in keys[:-1]} | {above[-1]: F.shiftright(keys[-1], BITS)})
        parents = base.select(group, *(F.col(c).alias(f"up_{c}") for c in keys), F.col("first").alias("up_first"), "size")
        before = Window.partitionBy(group, *above).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1)
        base = child.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).join(parents, [group, *above]).select(group, *own, (F.col("up_first") + F.col("off")).alias("first"), "size")
        keys = own
    at, shift = level
    names = [f"bucket_{k}" for k in keys]
    bucket = dict(zip(names, [*(F.col(c) for c in digits[:at]), F.shiftright(digits[at], min(shift, 63))], strict=True))
    base = base.select(group, *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "first", "size")
    within = F.row_number().over(Window.partitionBy(group, *names).orderBy(*order)) - 1
    out = rows.withColumns(bucket).join(base, [group, *names]).withColumn("rank", F.col("first") + within)
    return out.select(*(f"`{c}`" for c in rows.columns), "rank", "size")
