"""Gates of a build: heterogeneous checks in one table, each against its bounds and the last snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: By how much a count may exceed the last snapshot's before it is a warning or a failure.
THRESHOLDS = {"collisions_title_norm": (20, 200), "dup_content_hashes": (10, 200), "anomalies_total": (200, 2000)}
HARD = ("emoji_files", "files_without_record", "records_without_file", "hash_missing", "hash_differs")
CHECKS = (*HARD, *THRESHOLDS)


def _count(df: DataFrame, gate: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(gate).alias("gate"), "value")


def measure(files: DataFrame, records: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """gate, value for each of CHECKS. files (path, text): what is there; records (path, title_norm, hash_sha256_v2): what is known of it.

    emoji_files: files with an emoji. files_without_record, records_without_file: coverage both ways, by path.
    hash_missing: records without a hash. hash_differs: records whose hash isn't the one computed
    from the file. collisions_title_norm: records of titles that several have. dup_content_hashes:
    hashes that several files have. Each text is read once; no text is shuffled.
    """
    seen = files.select("path", F.coalesce(F.col("text").rlike(T.emoji("gate")), F.lit(False)).alias("emoji"), T.hash_v2("text").alias("own"))
    known = records.select("path", "title_norm", F.col("hash_sha256_v2").alias("hash"))
    there = F.lit(True)
    both = seen.withColumn("file", there).join(known.withColumn("record", there), "path", "full")
    one = lambda c: F.count_if(c).alias("value")
    c = F.col
    paired: dict[str, Column] = {
        "emoji_files": c("file") & c("emoji"),
        "files_without_record": c("record").isNull(),
        "records_without_file": c("file").isNull(),
        "hash_missing": c("record") & c("hash").isNull(),
        "hash_differs": c("file") & c("record") & (c("hash") != c("own")),
    }
    flat = both.agg(*(one(cond).alias(k) for k, cond in paired.items()))
    out = flat.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), c(k).alias("value")) for k in paired))).alias("x")).select("x.*")
    titles = known.filter("title_norm is not null").groupBy("title_norm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = out.unionByName(titles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(F.lit("collisions_title_norm").alias("gate"), "value"))
    out = out.unionByName(_count(seen.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dup_content_hashes"))
    if anomalies is not None:
        out = out.unionByName(_count(anomalies, "anomalies_total"))
    return out


def judge(values: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """gate, value, before, delta, status. HARD gates fail above 0; the others warn and fail by what they exceed the last snapshot (gate, value).

    Without a last snapshot, or without the gate in it, there is nothing to exceed.
    """
    x = values if last is None else values.join(last.select("gate", F.col("value").alias("before")), "gate", "left")
    x = x if "before" in x.columns else x.withColumn("before", F.lit(None).cast("long"))
    x = x.withColumn("delta", F.col("value") - F.col("before"))
    status = F.when(F.col("gate").isin(*HARD), F.when(F.col("value") > 0, "FAIL").otherwise("OK"))
    for gate, (warn, fail) in THRESHOLDS.items():
        status = status.when(F.col("gate") == gate, F.when(F.col("delta") > fail, "FAIL").when(F.col("delta") > warn, "WARN").otherwise("OK"))
    return x.select("gate", "value", "before", "delta", status.otherwise("OK").alias("status"))


def passed(judged: DataFrame) -> bool:
    return judged.filter("status = 'FAIL'").isEmpty()


def run(files: DataFrame, records: DataFrame, snapshots, snapshot_id: str, at: str, anomalies: DataFrame | None = None) -> DataFrame:
    """Measure, judge against the last snapshot in ``snapshots`` (a versioned table) and, if nothing fails, add this one to it."""
    entry = snapshots.entry()
    last = None
    if entry:
        before = snapshots.read()
        latest = before.agg(F.max(F.struct("at", "snapshot_id")).alias("s")).select("s.*")
        last = before.join(F.broadcast(latest), ["at", "snapshot_id"]).select("gate", "value")  # one row
    judged = judge(measure(files, records, anomalies), last).persist()
    try:
        rows = judged.collect()  # one row a gate
    finally:
        judged.unpersist()
    out = files.sparkSession.createDataFrame(rows, judged.schema)
    if all(r.status != "FAIL" for r in rows):
        new = out.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(at).alias("at"), "gate", "value")
        snapshots.refresh(lambda old: new if old is None else old.unionByName(new))
    return out
