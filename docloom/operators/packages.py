"""Industries dealt into packages of about equal numbers of documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources import versions


def _ordered(counts: DataFrame) -> DataFrame:
    """code, tag, n with ``before`` (the sum of n of smaller codes) and ``rank`` (their number), from range partitions and the sums of these."""
    spark = counts.sparkSession
    path = versions.scratch(spark, "packages")
    k = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts.select("code", "tag", "n").repartitionByRange(k, "code").withColumn("range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    start = (Window.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))  # a row for each partition
    so_far = Window.orderBy("range").rowsBetween(*start)
    base = sums.select("range", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_base") for c in "sc"))
    own = Window.partitionBy("range").orderBy("code")
    x = rows.join(F.broadcast(base), "range")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(*start)), F.lit(0)) + F.col("s_base")
    return x.select("code", "tag", "n", before.alias("before"), (F.row_number().over(own) - 1 + F.col("c_base")).alias("rank"))


def packages(counts: DataFrame, target: int = 10) -> DataFrame:
    """counts (code, tag, n; codes are unique) -> package (from 1), code, tag, n.

    In order of code a package is filled up to ceil(total / target); what comes after the last one's start stays in it. If these are
    too few, the last package is halved by its number of codes until there are ``target`` or it is one code.

    The walk goes from package to package, not from code to code: where the next one starts is the first code whose sum
    goes beyond the limit, one aggregate over all codes, so it takes at most ``target`` of them.
    """
    x = _ordered(counts)
    total, n_codes = x.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_codes:
        return counts.select(F.lit(1).alias("package"), "code", "tag", "n").limit(0)
    full, starts, sums = math.ceil(total / target), [0], 0
    while len(starts) < target:
        beyond = (F.col("rank") > starts[-1]) & (F.col("before") + F.col("n") - sums > full)
        at = x.filter(beyond).agg(F.min(F.struct("rank", "before")).alias("s")).first().s
        if at is None:
            break
        starts.append(at.rank)
        sums = at.before
    while len(starts) < target and n_codes - starts[-1] > 1:
        starts.append(starts[-1] + (n_codes - starts[-1]) // 2)
    package = sum(((F.col("rank") >= s).cast("int") for s in starts), F.lit(0))
    return x.select(package.alias("package"), "code", "tag", "n")


def markdown(dealt: DataFrame) -> DataFrame:
    """One Markdown text per package: a heading, its total and a line per code."""
    line = F.concat(F.lit("- "), "code", F.lit(" "), F.coalesce("tag", F.lit("")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    x = dealt.groupBy("package").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("code", line.alias("line")))).alias("ls"))
    return x.select("package", F.concat(F.lit("# Package "), F.col("package").cast("string"), F.lit("\n\nDocuments: "), F.col("n").cast("string"), F.lit("\n\n"), F.array_join("ls.line", "\n"), F.lit("\n")).alias("text"))
