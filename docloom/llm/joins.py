"""An inner join whose left side may have a third of its rows on one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
HOT = 20_000


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; the right side has few rows of a key.

    The left rows of a key are dealt into buckets by the columns ``by``, which tell them apart, and the right rows go to
    the buckets of their key that there are: keys and buckets are made distinct in each task before
    they are shuffled, so no task gets more than a bucket of a key. ``left`` is read twice, so it should be a written table
    or cheap, and ``by`` must have the same values each time.
    """
    dealt = left.withColumn("spread_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    asked = dealt.select(*keys, "spread_bucket").distinct().join(right, keys)
    return dealt.join(asked, [*keys, "spread_bucket"]).drop("spread_bucket")


def largest(df: DataFrame, keys: list[str]) -> int:
    """How many rows the most frequent key has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def inner(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    """The same join, spread only if a key has more than HOT rows (``most`` says how many the most frequent one has)."""
    return spread(left, right, keys, by) if most > HOT else left.join(right, keys)
