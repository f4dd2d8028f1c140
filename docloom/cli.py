"""``python -m docloom.cli --tables DIR COMMAND``: lookups over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.operators import analytics, audit, fixes, graph, services
from docloom.sources import files, schemas


def _table(spark: SparkSession, args, name: str):
    """A table; columns that an older one lacks are there, as nulls."""
    df = spark.read.parquet(f"{args.tables.rstrip('/')}/{name}.parquet")
    return schemas.conform(df, name) if name in ("mapping", "regulation_mapping") else df


def find(spark, args) -> int:
    """Mapped documents of standards (or regulations) that contain the text; at most ``--limit`` lines, then how many more."""
    docs = _table(spark, args, "docs").select(F.col("path").alias("doc_path"), "title")
    name, code, text = ("mapping", "standard_code", args.standard) if args.standard else ("regulation_mapping", "regulation_code", args.regulation)
    x = _table(spark, args, name).filter(F.col(code).contains(text)).join(docs, "doc_path").select("doc_path", code, "title").distinct()
    rows, n = x.orderBy("doc_path", code, "title").limit(args.limit).collect(), x.count()
    print(*(f"{r.doc_path}  [{r[code]}]  {r.title or ''}" for r in rows), sep="\n")
    if n > len(rows):
        print(f"... and {n - len(rows)} more")
    return 0


def contract(spark, args) -> int:
    print(json.dumps(services.contract(_table(spark, args, "contracts"), args.uid).first().asDict(), ensure_ascii=False, indent=2))
    return 0


def validate(spark, args) -> int:
    """1 if a document has violations of severity ERROR."""
    rows = fixes.violations(files.markdown(spark, args.path)).orderBy("path", "violation_type").toLocalIterator()
    bad = 0
    for r in rows:
        bad |= r.severity == "ERROR"
        print(f"{r.severity}  {r.path}  {r.violation_type}")
    return int(bad)


def check(spark, args) -> int:
    """1 unless the folder has all tables of the profile."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(args.tables)
    there = {s.getPath().getName().removesuffix(".parquet") for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)}
    lacks = services.missing(there, args.profile)
    print("OK" if not lacks else "missing: " + ", ".join(lacks))
    return int(bool(lacks))


def rhythm(spark, args) -> int:
    """What must come before a node and what comes after it, edge by edge."""
    edges, start = _table(spark, args, "edges"), spark.range(1).select(F.lit(args.uid).alias("node"))
    kind = F.col("edge_type") if "edge_type" in edges.columns else F.lit("")
    edges = edges.select(F.col("from_node").cast("string").alias("from_node"), F.col("to_node").cast("string").alias("to_node"), kind.alias("edge_type"))
    for name, up in (("upstream", True), ("downstream", False)):
        print(f"{name}:")
        for r in graph.walk(edges, start, args.depth, up).orderBy("distance", "from_node", "to_node", "edge_type").toLocalIterator():
            print(f"  d={r.distance}  {r.from_node} --[{r.edge_type}]--> {r.to_node}")
    return 0


def coverage(spark, args) -> int:
    """Documents per standard, those with few (``--gaps`` below ``--least``), and the totals."""
    m, docs = _table(spark, args, "mapping"), _table(spark, args, "docs")
    x = analytics.below(m, args.least) if args.gaps else analytics.coverage_by_standard(m)
    for r in x.orderBy(F.desc("n_docs"), "standard_code").toLocalIterator():
        print(f"{r.standard_code}  {r.n_docs}")
    t = analytics.totals(docs, m).first()
    print(f"{t.mapped} of {t.total} documents, {t.pct:.1f}%")
    return 0


def audit_all(spark, args) -> int:
    """Statistics of the tables that are there and, with ``--ci``, 1 unless all gates hold."""
    there = lambda n: _table(spark, args, n) if _exists(spark, f"{args.tables.rstrip('/')}/{n}.parquet") else None
    m, v, standards = there("mapping"), there("template_violations"), there("standards")
    stats = audit.statistics(m, v)
    for name, value in stats.first().asDict().items():
        print(f"{name}  {value}")
    if not args.ci or m is None or standards is None:
        return int(args.ci)
    bad = 0
    for r in audit.continuous(stats, m, standards, args.standard, args.least).toLocalIterator():
        print(f"{'OK' if r.ok else 'FAIL'}  {r.gate}  {r.value:g}")
        bad |= not r.ok
    return int(bad)


def backfill(spark, args) -> int:
    """Confidences for mappings without one, written to ``--target``; without it only their number is shown."""
    x = audit.backfill(_table(spark, args, "mapping"), _table(spark, args, "standards"), _table(spark, args, "guided"))
    if args.target:
        x.drop("filled").write.mode("overwrite").parquet(args.target)
    print(f"{x.filter('filled').count()} rows")
    return 0


def report(spark, args) -> int:
    print(analytics.health_report(_table(spark, args, "docs"), _table(spark, args, "mapping")), end="")
    return 0


def fix(spark, args) -> int:
    """Plan fixes of a folder of Markdown, and show or write them."""
    run_id = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = fixes.run(spark, args.root, args.mode, args.plan, run_id, args.only_safe, args.target, args.backup, lambda m: print(m, file=sys.stderr))
    if args.mode == "dry-run":
        for r in out.orderBy("path").toLocalIterator():
            print(r["diff"])
    elif args.mode == "analyze":
        _summary(out)
    else:
        for r in out.groupBy("status").count().orderBy("status").collect():
            print(f"{r.status}  {r['count']}")
    return 0


def _summary(plan) -> None:
    for r in fixes.plan_summary(plan).orderBy("rule_id").collect():
        print(f"{r.severity}  {r.rule_id}  {r.n} in {r.files} files{'' if r.safe else ', for review'}")


def review(spark, args) -> int:
    """What a saved plan holds, by rule; with ``--verbose`` change by change."""
    plan = fixes.selected(fixes.load_plan(spark, args.plan), args.filter)
    _summary(plan)
    if args.verbose:
        for r in plan.orderBy("path", "seq").toLocalIterator():
            print(f"  {r.path}  {r.rule_id}  {r.section or ''}".rstrip())
    return 0


def apply(spark, args) -> int:
    """Apply a saved plan; 1 if a document of it isn't there."""
    if not _exists(spark, args.plan):
        print(f"error: no plan {args.plan}", file=sys.stderr)
        return 1
    lost: list[str] = []
    out = fixes.apply_saved(spark, args.plan, args.filter, args.target, args.backup, lost.append, args.write_diff, args.write_result)
    for r in out.groupBy("status").count().orderBy("status").collect():
        print(f"{r.status}  {r['count']}")
    print(*lost, sep="\n", file=sys.stderr, end="\n" if lost else "")
    return int(bool(lost))


def bootstrap(spark, args) -> int:
    """Empty typed tables of a profile that aren't there yet."""
    for path in schemas.bootstrap(spark, args.tables, args.profile):
        print(f"made {path}")
    return 0


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


COMMANDS = {f.__name__.removesuffix("_all"): f for f in (find, contract, validate, check, rhythm, coverage, audit_all, backfill, report, fix, review, apply, bootstrap)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--tables", default=os.environ.get("DOCLOOM_TABLES", "."), help="folder of the tables, NAME.parquet each")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("find")
    what = f.add_mutually_exclusive_group(required=True)
    what.add_argument("--standard")
    what.add_argument("--regulation")
    f.add_argument("--limit", type=int, default=20)
    sub.add_parser("contract").add_argument("uid")
    sub.add_parser("validate").add_argument("path")
    for name in ("check", "bootstrap"):
        sub.add_parser(name).add_argument("--profile", choices=sorted(services.PROFILES), default="legacy-runtime")
    r = sub.add_parser("rhythm")
    r.add_argument("uid")
    r.add_argument("--depth", type=int, default=2)
    c = sub.add_parser("coverage")
    c.add_argument("--gaps", action="store_true")
    c.add_argument("--least", type=int, default=1)
    a = sub.add_parser("audit")
    a.add_argument("--ci", action="store_true")
    a.add_argument("--standard", default="%27001%")
    a.add_argument("--least", type=float, default=audit.LEAST_COVERAGE)
    sub.add_parser("backfill").add_argument("--target")
    sub.add_parser("report")
    x = sub.add_parser("fix")
    x.add_argument("root")
    x.add_argument("--mode", choices=fixes.MODES, default="analyze")
    x.add_argument("--plan", required=True)
    x.add_argument("--only-safe", action=argparse.BooleanOptionalAction, default=True)
    x.add_argument("--target")
    x.add_argument("--backup")
    v = sub.add_parser("review")
    v.add_argument("plan")
    v.add_argument("--filter", choices=fixes.FILTERS, default="all")
    v.add_argument("--verbose", action="store_true")
    y = sub.add_parser("apply")
    y.add_argument("plan")
    y.add_argument("--filter", choices=fixes.FILTERS, default="safe")
    y.add_argument("--target", required=True)
    y.add_argument("--backup", required=True)
    y.add_argument("--write-diff")
    y.add_argument("--write-result")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    try:
        return COMMANDS[args.command](spark, args)
    except services.QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
