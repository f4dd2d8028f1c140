"""A training corpus from raw documents: five stages, each written and read again as the next one's input.

Toxic documents go, then exact copies, then all but one of each group of near
copies, then documents that hold benchmark passages; what is left is mixed to
target weights. Every stage but the last keeps the columns of documents. Rows without
doc_id are judged like others where that needs no id, and kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from docloom.llm.store import materialize, sweep, written

#: No SQL: the first stage is a trained model. Tests hold the stages against brute force.
ORACLE_SQL = None
TOXIC = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model learns from the labelled documents of this input."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return toxicity.drop(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    groups = exact_dedup.exact_groups(docs)
    kept = groups.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__sha": exact_dedup.normal_sha256("text")})
    rows = keyed.join(kept, keyed["__id"].eqNullSafe(kept["__id"]) & (keyed["__sha"] == kept["__sha"]), "left_semi")
    # Rows that repeat an id with an equal text: one of them (the join has sorted them already).
    again = Window.partitionBy("__id", "__sha").orderBy("__id")
    return rows.withColumn("__n", F.row_number().over(again)).filter("__n = 1").select([F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (rows without one come last, then the first row).

    Rows are known by a number that is written with them, so repeated and missing ids do no harm.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.jaccard_groups(rows.select(F.col("__row").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", F.col("doc_id").alias("__id")), "__row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("b"))
    gone = groups.select(F.col("doc_id").alias("__row")).join(best.select(F.col("b.__row").alias("__row")), "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    judged = decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark"), name="__overlaps")
    return judged.filter(F.size("__overlaps") == 0).drop("__overlaps")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, in blocks of the target mixture."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(before, docs)  # all but this stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
