"""URL filters by a sorted sweep.

A host's labels are reversed (``a.b.com`` -> ``com.b.a.``), so a rule for a host and
all its subdomains is an interval of keys, and intervals are nested or disjoint.
The URLs are range-partitioned and sorted by key and path; each task sweeps its range
once, keeping a stack of the hosts with active rules. The paths of a host's rules are
sorted too, and each knows the longest other one that it begins with, so the rules that a path
is in are found from its place among them. The page id is part of the range key, so a
host with a third of all pages is split over tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import spread
from .store import parts

MAX_RULES = 200_000  # rules sent to every task at most; beyond it rules are joined by host suffix


def host_and_path(url: str = "url") -> list:
    """Host and path columns. Null or no ``://``: both empty. Only A-Z is lower-cased."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")]


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Paths:
    """The rules of one host by path."""

    def __init__(self, host: str, rules: dict[str, str]):
        self.host, self.paths = host, sorted(rules)
        self.verdicts = [rules[p] for p in self.paths]
        self.outer: list[int] = []  # the longest rule that a rule's path begins with, -1 if none
        stack: list[int] = []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[int, int, str, str] | None:
        """Length of host and path, of the host, the rule and its verdict."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        if i < 0:
            return None
        return len(self.host) + len(self.paths[i]), len(self.host), self.host + self.paths[i], self.verdicts[i]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    ``rules``: (verdict, host, path). A rule fits its host and its subdomains where the
    path starts with the rule's; the longest (host and path together, then host)
    wins, of the same rule given twice the last. Without a rule: null and ``default``.
    Repeated rows are each judged; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", *host_and_path())
    own = {(h, p): v for v, h, p in rules}
    if len(own) > max_rules:
        return _by_suffix(urls, spark.createDataFrame([(v, h, p) for (h, p), v in own.items()], "verdict string, rule_host string, rule_path string"), default)
    table: dict[str, dict[str, str]] = {}
    for (h, p), v in own.items():
        table.setdefault(h, {})[p] = v
    held = spark.sparkContext.broadcast(sorted(((reversed_key(h), Paths(h, by)) for h, by in table.items()), key=lambda x: x[0]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, nxt, stack, last, hit = held.value, 0, [], None, None
        for batch in batches:
            rule, verdict = [], []
            for key, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last is None or key != last[0]:
                    while nxt < len(entries) and entries[nxt][0] <= key:
                        while stack and not entries[nxt][0].startswith(stack[-1][0]):
                            stack.pop()
                        stack.append(entries[nxt])
                        nxt += 1
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                if last != (key, path):
                    hit, last = max((x for _, paths in stack if (x := paths.longest(path))), default=None), (key, path)
                rule.append(hit[2] if hit else None)
                verdict.append(hit[3] if hit else default)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    key = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    n = parts(spark)
    kind = dict(urls.dtypes)["page_id"]
    return urls.withColumn("key", key).repartitionByRange(n, "key", "path", "page_id").sortWithinPartitions("key", "path").mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def _by_suffix(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join on host suffixes, for rule tables too large to send around."""
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    size = F.length("rule_host") + F.length("rule_path")
    hits = urls.withColumn("rule_host", F.explode(F.array_distinct(F.concat(suffix, F.array(F.lit(""))))))
    hits = spread(hits, rules, ["rule_host"], ["page_id", "path"]).filter(F.expr("startswith(path, rule_path)"))
    best = hits.groupBy("row").agg(F.max(F.struct(size, F.length("rule_host").alias("hl"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("b"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
