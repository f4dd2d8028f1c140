"""Files in: Markdown trees, manifests, logs, plans. Readers are lazy and have fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, text of every ``*.md`` below ``root`` (one row per file)."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive)
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def texts(spark: SparkSession, root: str, extensions: list[str], skip: list[str], keep_bad: bool = False) -> DataFrame:
    """path, text of files with an extension; a skipped name may stand anywhere in the path below ``root``.

    Files that aren't UTF-8 are left out, or have a null text with ``keep_bad``.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    df = df.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    top = root.rstrip("/").rpartition("://")[2].removeprefix("file:")
    below = F.substring_index("path", f"{top}/", -1) if top else F.col("path")
    for s in skip:
        df = df.filter(~below.contains(s))
    df = df.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    return df if keep_bad else df.filter("text is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, hash_sha256_v2 of a CSV manifest: blank paths go, blank hashes are null, no path column is an error."""
    df = spark.read.option("header", True).csv(path)
    if "path" not in df.columns:
        raise ValueError("manifest has no column 'path'")
    h = F.nullif(F.trim("hash_sha256_v2"), F.lit("")) if "hash_sha256_v2" in df.columns else F.lit(None).cast("string")
    return df.select(F.trim("path").alias("path"), h.alias("hash_sha256_v2")).filter("path <> ''")


def alignment_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("path string, aligned_rev string, aligned_at string, aligned_by string").csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: A saved plan: a document of its own, with a change's details as a map.
CHANGE = "file string, rule_id string, severity string, action string, detail map<string,string>, safe_autofix boolean"
PLAN = f"schema_version string, run_id string, mode string, root string, total_files long, changes array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHANGE.split(', '))}>>"


def plan(spark: SparkSession, path: str) -> DataFrame:
    """The changes of saved fix plans, with their place in the plan: a file is one JSON document, a folder's files have one a line."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    x = spark.read.option("multiLine", single).schema(PLAN).json(path)
    return x.select("schema_version", "run_id", "mode", "root", "total_files", F.posexplode("changes").alias("seq", "c")).select("schema_version", "run_id", "mode", "root", "total_files", "seq", "c.*")


def git_records(spark: SparkSession, path: str) -> DataFrame:
    """record: each commit of ``git log --name-status`` in the form COMMIT|hash|date|subject|author and its files.

    Records are cut by the reader itself, so one log of any length is read by many tasks.
    """
    x = spark.read.option("lineSep", "\nCOMMIT|").text(path)
    return x.select(F.regexp_replace("value", r"\ACOMMIT\|", "").alias("record")).filter(F.trim("record") != "")


def git_changes(records: DataFrame) -> DataFrame:
    """One row per changed file: hash, date, subject, author, status (A, M, D or R), path, old_path. Subjects may hold bars."""
    ls = F.split("record", "\r?\n")
    head = F.split(F.element_at("ls", 1), r"\|")
    n = F.size(head)
    fields = {"hash": head[0], "date": head[1], "subject": F.array_join(F.slice(head, F.lit(3), F.greatest(n - 3, F.lit(1))), "|"), "author": F.when(n > 3, F.element_at(head, -1))}
    x = records.select(ls.alias("ls")).select(*(v.alias(k) for k, v in fields.items()), F.explode("ls").alias("line"))
    p = F.split("line", "\t")
    return x.filter(F.col("line").rlike(r"^[AMDR]\d*\t")).select(*fields, F.substring("line", 1, 1).alias("status"), F.element_at(p, -1).alias("path"), F.when(F.size(p) > 2, p[1]).alias("old_path"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """The changed files of a git log."""
    return git_changes(git_records(spark, path))


def policy(spark: SparkSession, path: str) -> dict:
    """A policy in YAML as a dict, read on the driver (it is a page of settings). YAML is optional: without it an error says so."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a policy needs PyYAML") from e
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    return yaml.safe_load(text) or {}
