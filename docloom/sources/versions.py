"""Tables in versions: new files first, then one entry of a commit log that names them.

A table is a folder. Each version's rows are Parquet files in a folder of their own that no
later version changes; ``_log/N.json`` is the Nth commit and says which folder holds each part.
Readers take the last commit, so they see a version as a whole or the one before it. A
writer that dies half-way leaves files that no commit names. A commit is published by a
rename that fails if its number is taken, so of two writers one has to start over. Former
versions are the backup: ``rollback`` commits an old one again.

A table may be cut into parts by the hash of a key; a commit then rewrites only the parts that it
touches and names the others' former folders.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_PARTS = 4096
WHOLE = "all"
#: Spark removes the shuffle files of a query once it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer has taken the commit's number."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one on a local master. It goes when the program ends."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.gettempdir()
    path = f"{top.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


_scratch: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for path, spark in _scratch.items():
            _delete(spark, path)


@contextlib.contextmanager
def temporary(spark: SparkSession, name: str) -> Iterator[str]:
    """A scratch folder that goes at the end of the block."""
    path = scratch(spark, name)
    try:
        yield path
    finally:
        _delete(spark, path)
        del _scratch[path]


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` added to the files at ``path``, and these read again. Its shuffle files go with the write."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


class Table:
    """A versioned table at ``path``; ``key`` and ``parts`` cut it by the hash of a column."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, parts: int = 1):
        if parts > MOST_PARTS or (parts > 1 and not key):
            raise ValueError(f"a key and at most {MOST_PARTS} parts")
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- the log

    def versions(self) -> list[int]:
        log = self._p("_log")
        if not self._fs.exists(log):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(log))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def entry(self, version: int | None = None) -> dict | None:
        """A commit: version, parts (folder by part), schema, note. The last one by default; null if there is none."""
        known = self.versions()
        if version is None and not known:
            return None
        at = known[-1] if version is None else version
        if at not in known:
            raise LookupError(f"{self.path} has no version {at}")
        stream = self._fs.open(self._p(f"_log/{at}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, parts: dict[str, str], schema: dict, note: dict) -> None:
        temp = self._p(f"_log/.{uuid.uuid4().hex}")
        out = self._fs.create(temp)
        try:
            out.write(bytearray(json.dumps({"version": version, "parts": parts, "schema": schema, "note": note}).encode()))
        finally:
            out.close()
        final = self._p(f"_log/{version}.json")
        # Local file systems rename over a file that is there; others refuse.
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # -- rows

    def part(self, column=None):
        """The part of a row: from its key alone, so the same in every version."""
        if self.parts == 1:
            return F.lit(WHOLE)
        return F.pmod(F.xxhash64(F.col(self.key) if column is None else column), F.lit(self.parts)).cast("string")

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """A version's rows, the last one's by default, or those of some of its parts."""
        e = self.entry(version)
        if e is None:
            raise LookupError(f"{self.path} has no version yet")
        folders = sorted({f for p, f in e["parts"].items() if parts is None or p in parts})
        if not folders:
            return self.spark.createDataFrame([], T.StructType.fromJson(e["schema"]))
        return self.spark.read.schema(T.StructType.fromJson(e["schema"])).parquet(*(f"{self.path}/{f}" for f in folders))

    def refresh(self, build: Callable[[DataFrame | None], DataFrame], note: dict | None = None) -> int:
        """All rows anew from ``build``, which gets the last version (null at first) and may read it. The new version."""
        last = self.entry()
        return self._write(last, build(self.read() if last else None), {}, note or {})

    def refresh_by(self, slices: Iterable[DataFrame], note: dict | None = None, constant: tuple[str, str] | None = None) -> int:
        """All rows anew, slice by slice: each is written, and its shuffle files deleted, before the next one is asked for. One commit at the end.

        ``constant``: a last column's name and its one value, kept as the folder's name and not row by row.
        """
        if self.parts > 1:
            raise ValueError("a table in one part")
        if constant and not all(re.fullmatch(r"\w+", x) for x in constant):
            raise ValueError("a constant of letters, digits and _")
        within = "/{}={}".format(*constant) if constant else ""
        last = self.entry()
        version = (last["version"] if last else 0) + 1
        folder, schema = f"v{version}-{uuid.uuid4().hex[:12]}", None
        for rows in slices:
            schema = written(rows, f"{self.path}/{folder}{within}").schema
        if schema is None:
            raise ValueError("no slice")
        if constant:
            schema = T.StructType([*schema, T.StructField(constant[0], T.StringType())])
        self._publish(version, {WHOLE: folder}, schema.jsonValue(), note or {})
        return version

    def replace_parts(self, rows: DataFrame, touched: list[str], note: dict | None = None) -> int:
        """``rows`` in place of all that the parts in ``touched`` hold; other parts keep their files."""
        last = self.entry()
        kept = {p: f for p, f in (last["parts"] if last else {}).items() if p not in touched}
        return self._write(last, rows, kept, note or {})

    def _write(self, last: dict | None, rows: DataFrame, kept: dict[str, str], note: dict) -> int:
        version = (last["version"] if last else 0) + 1
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        schema = rows.schema.jsonValue()
        if self.parts == 1:
            rows.write.parquet(f"{self.path}/{folder}")
            made = {WHOLE: folder}
        else:
            rows.withColumn("__part", self.part()).repartition("__part").write.partitionBy("__part").parquet(f"{self.path}/{folder}")
            there = (s.getPath().getName() for s in self._fs.listStatus(self._p(folder)) if s.isDirectory())
            made = {n.removeprefix("__part="): f"{folder}/{n}" for n in there if n.startswith("__part=")}
        self._publish(version, kept | made, schema, note)
        return version

    # -- old versions

    def rollback(self, version: int) -> int:
        """A former version's rows as the new one; nothing is written but the commit."""
        old, last = self.entry(version), self.entry()
        self._publish(last["version"] + 1, old["parts"], old["schema"], {"rollback": version})
        return last["version"] + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last ``keep`` commits names, and older commits. The folders.

        Not while a writer is at work: its files have no commit yet.
        """
        known = self.versions()
        used = {f.split("/")[0] for v in known[-keep:] for f in self.entry(v)["parts"].values()}
        gone = [n for s in self._fs.listStatus(self._p("")) if s.isDirectory() and re.match(r"v\d+-", n := s.getPath().getName()) and n not in used]
        for v in known[:-keep]:
            self._fs.delete(self._p(f"_log/{v}.json"), False)
        for n in gone:
            self._fs.delete(self._p(n), True)
        return gone
