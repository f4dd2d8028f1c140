"""Sections rebuilt for what changed: manifests compared, changed documents done anew, the others' files left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as T
from docloom.sources import versions

from . import quality

PARTS = 64


def manifest(docs: DataFrame) -> DataFrame:
    """path, hash_sha256_v2 of documents (path, text)."""
    return docs.select("path", T.hash_v2("text").alias("hash_sha256_v2"))


def changes(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """path, hash_sha256_v2, change: added, changed or removed between two manifests; equal rows aren't in it.

    A null hash is a document that wasn't read, so it counts as changed.
    """
    if old is None:
        return new.select("path", "hash_sha256_v2", F.lit("added").alias("change"))
    was = old.select("path", F.col("hash_sha256_v2").alias("__was"), F.lit(True).alias("__old"))
    x = new.select("path", "hash_sha256_v2", F.lit(True).alias("__new")).join(was, "path", "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("hash_sha256_v2") == F.col("__was"), None).otherwise("changed")
    return x.select("path", "hash_sha256_v2", change.alias("change")).filter("change is not null")


def tables(spark: SparkSession, store: str, parts: int = PARTS) -> tuple[versions.Table, versions.Table]:
    """The section table and the manifest below ``store``."""
    return tuple(versions.Table(spark, f"{store.rstrip('/')}/{n}", "path", parts) for n in ("sections", "manifest"))


def rebuild(docs: DataFrame, store: str, complete: bool = True, parts: int = PARTS) -> dict[str, int]:
    """Bring the section table below ``store`` up to documents (path, text); how many were added, changed and removed.

    Only changed documents are cut into sections, and only the parts of the table that hold
    them are written. With ``complete`` documents that are no longer there lose their sections;
    without it ``docs`` is a batch, and others stay. The sections are committed before the
    manifest: a run that dies between finds the same changes again and ends with the same rows.
    """
    spark = docs.sparkSession
    sections, known = tables(spark, store, parts)
    old = known.read() if known.entry() else None
    found = changes(manifest(docs), old)
    if not complete:
        found = found.filter("change <> 'removed'")
    found = found.withColumn("part", known.part(F.col("path"))).persist()
    try:
        counts = {r.change: r.n for r in found.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = [r.part for r in found.select("part").distinct().collect()]  # ``parts`` at most
        if touched:
            fresh = quality.sections(docs.join(found.filter("change <> 'removed'").select("path"), "path", "left_semi"), "path", rebuilt=True)
            gone = found.select("path")
            keep = lambda t: t.read(parts=touched).join(gone, "path", "left_anti") if t.entry() else None
            note = {"changes": counts}
            stay = keep(sections)
            sections.replace_parts(fresh if stay is None else stay.unionByName(fresh), touched, note)
            rows, stay = found.filter("change <> 'removed'").select("path", "hash_sha256_v2"), keep(known)
            known.replace_parts(rows if stay is None else stay.unionByName(rows), touched, note)
    finally:
        found.unpersist()
    return counts


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keep the section table up to a folder of JSON lines (path, text), each a document that is new or has changed.

    Every file is taken once. Of a path's several rows in a batch the one of the latest file counts
    (of one file's the greatest text); a null text empties the document. A batch that is replayed after a
    failure finds its hashes in the manifest and changes nothing.
    """
    late = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.coalesce("text", F.lit("")))
    rows = spark.readStream.schema("path string, text string").json(root).filter("path is not null").select("path", late.alias("late"))

    def step(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max("late").alias("late"))
        rebuild(last.select("path", F.col("late.col3").alias("text")), store, False, parts)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
