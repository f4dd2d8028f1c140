"""Exact dedup: a tree merge of sorted digest runs, in DataFrame functions only.

Every row is digested once. The rows are dealt into leaf runs; in each round
``FAN`` runs meet in one, digest by digest, and the best row and the count of
each digest go on. A run is itself spread over tasks by its digests, so no task
sees a whole run. The winners then go down the same tree: at each level a digest
meets its parent once per run, so a text that fills a third of the table costs
no task more than its share.

Rows are equal when SHA-256, a second independent 64-bit hash and the length of
the normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, parts

FAN = 8
KEY = ["text_sha256", "check", "n_norm"]


def normal(text: str):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def normal_sha256(text: str):
    return F.sha2(normal(text).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = normal("text")
    return docs.select("doc_id", F.char_length(text).alias("n_points"), norm.alias("norm")).select(
        "doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.xxhash64("norm").alias("check"), F.char_length("norm").alias("n_norm")
    )


def exact_groups(docs: DataFrame, leaves: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as
    empty. The row with the most code points stays, then the smallest doc_id.
    A null doc_id ranks last. If a doc_id occurs in several equal rows, one of
    them stays (kept is judged by a row number that is dealt beforehand). An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    levels, size = 1, FAN
    while size < (leaves or parts(spark)):
        levels, size = levels + 1, size * FAN
    rows = digests(docs)
    rows = rows.select("*", F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(size)).cast("int")), "digests")
    # Least struct first: most code points, then ids (null last), then the row number.
    best = F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    tree = [rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))]
    tree[0] = materialize(tree[0], "runs0")
    for level in range(levels):
        up = tree[-1].withColumn("run", F.floor(F.col("run") / FAN).cast("int")).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        tree.append(materialize(up, f"runs{level + 1}") if level + 1 < levels else up)
    down = tree.pop().select("run", *KEY, "best", "n")
    while tree:
        child = tree.pop().select("run", *KEY).withColumn("up", F.floor(F.col("run") / FAN).cast("int"))
        parent = down.withColumnRenamed("run", "up")
        down = child.join(parent, ["up", *KEY]).select("run", *KEY, "best", "n")
    out = rows.join(down, ["run", *KEY])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
