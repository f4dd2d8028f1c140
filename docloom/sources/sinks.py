"""Write modes as functions of the old and the new state, and small reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import versions


def full_refresh(df: DataFrame, path: str) -> None:
    """All rows anew, as a version of the table at ``path``: ``df`` may read the table itself, and a failure leaves it as it was."""
    versions.Table(df.sparkSession, path).refresh(lambda _: df)


def scoped_refresh(old: DataFrame, new: DataFrame, scope) -> DataFrame:
    """Old rows outside ``scope`` and the new ones."""
    return old.filter(~F.coalesce(scope, F.lit(False))).unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Old rows and, for keys they lack, the first new row by ``order``."""
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(one.join(old.select(*key).distinct(), key, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """New rows, and old rows whose key has none. With ``order`` the first new row of each key by it, else all."""
    if order is not None:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def update_by_key(old: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: list | None = None, blank: bool = False) -> DataFrame:
    """Columns of old replaced by those of the change with its key: the first by ``order`` (else by the columns), so no row is repeated.

    A null leaves the old value, unless ``blank``, when it replaces it too.
    """
    by = columns if order is None else order
    new = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("__n = 1").select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    value = lambda c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) if blank else F.coalesce(f"__{c}", c)
    return old.join(new, key, "left").select(*(value(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def delete_by_key(old: DataFrame, keys: DataFrame, key: list[str], unless=None) -> DataFrame:
    """Old rows without a key among ``keys``; rows for which ``unless`` holds stay in any case."""
    named = keys.select(*key).distinct()
    if unless is None:
        return old.join(named, key, "left_anti").select(old.columns)
    stay = F.coalesce(unless, F.lit(False))
    return old.filter(stay).unionByName(old.filter(~stay).join(named, key, "left_anti").select(old.columns))


RUN_LOG = "sync_id string, ran_at_utc string, kind string, status string, notes string"


def run_log(spark, run_id: str, ran_at: str, kind: str, status: str, notes: str, path: str) -> None:
    spark.createDataFrame([(run_id, ran_at, kind, status, notes)], RUN_LOG).write.mode("append").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    """The run log; empty if there is none yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(RUN_LOG).parquet(path) if there else spark.createDataFrame([], RUN_LOG)


class Notes:
    """What a stage says of itself: notes, and what it skipped. Calling it skips."""

    def __init__(self) -> None:
        self.said: list[str] = []
        self.skipped = False

    def note(self, text: str) -> None:
        self.said.append(text)

    def skip(self, text: str) -> None:
        self.skipped = True
        self.said.append(text)

    __call__ = skip


@contextmanager
def logged(spark, run_id: str, ran_at: str, kind: str, path: str):
    """A stage with its row in the run log: OK, WARN if the stage says that it skipped something, FAIL if it raises."""
    say = Notes()
    try:
        yield say
    except Exception as e:
        run_log(spark, run_id, ran_at, kind, "FAIL", str(e)[:1000], path)
        raise
    run_log(spark, run_id, ran_at, kind, "WARN" if say.skipped else "OK", "; ".join(say.said), path)


def json_report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small table as JSON lines in one file; more than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    df.coalesce(1).write.mode("overwrite").json(path)


def json_column(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def csv_report(df: DataFrame, path: str, raw: str | None = None) -> None:
    """A CSV report; commas in the ``raw`` column become spaces."""
    (df.withColumn(raw, F.regexp_replace(raw, ",", " ")) if raw else df).write.mode("overwrite").option("header", True).csv(path)


def unified_diff(df: DataFrame, before: str, after: str, name: str) -> DataFrame:
    """Adds ``diff``: the unified diff of two text columns, empty if equal."""
    import difflib

    @F.pandas_udf("string")
    def diff(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, n in parts:
            yield pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), f"a/{f}", f"b/{f}")) for x, y, f in zip(a, b, n, strict=True)])

    return df.withColumn("diff", diff(before, after, name))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A Markdown table of at most ``limit`` rows, for reports."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
