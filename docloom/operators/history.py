"""Snapshots, retention, transitions, sessions and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(log: DataFrame, key: str, at: str, gap_minutes: int) -> DataFrame:
    """A session number for each row: a new one after a gap of more than ``gap_minutes``."""
    w = Window.partitionBy(key).orderBy(at, "id")
    new = F.when(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_minutes * 60_000_000, 1).otherwise(0)
    return log.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def retention(snaps: DataFrame, weekly: int = 12, monthly: int = 12, baseline=None) -> DataFrame:
    """snapshot_id, at -> those kept: the first of each of the last weeks and months, and the baseline."""
    kept = None if baseline is None else snaps.filter(F.col("snapshot_id") == baseline).select("snapshot_id")
    for unit, n in (("week", weekly), ("month", monthly)):
        x = snaps.withColumn("p", F.date_trunc(unit, "at")).groupBy("p").agg(F.min(F.struct("at", "snapshot_id")).alias("f")).orderBy(F.desc("p")).limit(n).select(F.col("f.snapshot_id").alias("snapshot_id"))
        kept = x if kept is None else kept.unionByName(x)
    return kept.distinct()


def transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, hash of two snapshots -> from_path, to_path, kind: kept, moved, added, removed; every path of both once.

    A path that has the same hash in both is kept. Of a hash's other paths the old and the new ones,
    each in order, are paired as moves; what is left over was removed or added.
    """
    both = old.select("hash", "path").distinct().join(new.select("hash", "path").distinct(), ["hash", "path"])
    kept = both.select(F.col("path").alias("from_path"), F.col("path").alias("to_path"), F.lit("kept").alias("kind"))
    w = Window.partitionBy("hash").orderBy("path")
    side = lambda x, name: x.select("hash", "path").distinct().join(both, ["hash", "path"], "left_anti").select("hash", F.col("path").alias(name), F.row_number().over(w).alias("i"))
    x = side(old, "from_path").join(side(new, "to_path"), ["hash", "i"], "full")
    kind = F.when(F.col("from_path").isNull(), "added").when(F.col("to_path").isNull(), "removed").otherwise("moved")
    return kept.unionByName(x.select("from_path", "to_path", kind.alias("kind")))


def deltas(counts: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """metric, snapshot_id, n -> change against the metric's snapshot before, and its status by the metric's two bounds."""
    w = Window.partitionBy("metric").orderBy("snapshot_id")
    bound = lambda i: F.element_at(F.create_map(*(F.lit(v) for m, b in bounds.items() for v in (m, float(b[i])))), F.col("metric"))
    x = counts.withColumn("delta", F.col("n") - F.lag("n").over(w))
    return x.withColumn("status", F.when(F.col("delta") > bound(1), "FAIL").when(F.col("delta") > bound(0), "WARN").otherwise("OK"))
