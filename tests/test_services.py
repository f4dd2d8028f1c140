"""Services, run logs, reports and small functions."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import analytics, links, matching, services
from docloom.sources import files, sinks, versions


@pytest.fixture()
def views(spark):
    made = []

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
        made.append(name)

    yield put
    for name in made:
        spark.catalog.dropTempView(name)


def test_profiles_of_tables(spark, views):
    for name in services.PROFILES["current-snapshot"]:
        views(name, [] if name == "runs" else [(1,)], "id int")
    said = []
    assert services.validate(spark, "current-snapshot", said.append) == ["empty table: runs"] == said
    assert "found current-snapshot" in services.validate(spark, "legacy-runtime")[0]
    assert services.has_tables(services.tables(spark), {"runs"}) and not services.has_tables(services.tables(spark), {"runs", "nope"})
    assert services.health(spark)["status"] == "ok"


def test_link_resolution_needs_its_tables(spark, views):
    with pytest.raises(services.SchemaError):
        services.link_resolution(spark)
    views("content_links", [(1,), (2,)], "id int")
    views("content_links_resolved", [(1,), (1,)], "content_link_id int")
    assert services.link_resolution(spark).first().ratio == 0.5


def test_answers(spark):
    m = spark.createDataFrame([("a", "I", "R", 0.6), ("b", "I", "R", None), ("c", "I", "R", 0.7)], "doc_path string, standard_code string, match_reason string, confidence double")
    r = services.coverage(m, "I").first()
    assert (r.total, r.sure, r.very_sure, r.unknown, r.pct) == (3, 2, 1, 1, 66.7)
    with pytest.raises(services.QueryError):
        services.coverage(m, "none")
    v = spark.createDataFrame([("p", "X", "WARNING"), ("q", "Y", "ERROR")], "path string, violation_type string, severity string")
    assert [x.path for x in services.violations(v, spark).collect()] == ["q", "p"] and services.violations(v, spark, "error").count() == 1 and services.violations(None, spark).isEmpty()
    services.allowed("s", "s")
    for token, secret in (("x", "s"), (None, "s"), ("", ""), ("", None)):
        with pytest.raises(PermissionError):
            services.allowed(token, secret)
    docs = spark.createDataFrame([("a", "A"), ("z/z.md", "Z")], "path string, title string")
    text = analytics.health_report(docs, m)
    assert "| Unmapped | -1 |" in text and "| I | 3 |" in text and "Below 5" in text and "| z | 1 |" in text
    assert analytics.health_report(docs.limit(0), m.limit(0)).startswith("# Health")


def test_null_aware_not_in(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert [r.x for r in analytics.not_in(a, "x", b.filter("y is not null")).collect()] == [2] and analytics.not_in(a, "x", b).isEmpty()
    assert analytics.not_in(a, "x", b.limit(0)).count() == 3


def test_run_log_and_reports(spark, tmp_path):
    log = str(tmp_path / "log")
    with sinks.logged(spark, "1", "t", "edges", log) as skip:
        skip("two links")
    with sinks.logged(spark, "2", "t", "docs", log):
        pass
    with pytest.raises(KeyError), sinks.logged(spark, "3", "t", "docs", log):
        raise KeyError("gone")
    assert {r.sync_id: (r.status, r.notes) for r in spark.read.parquet(log).collect()} == {"1": ("WARN", "two links"), "2": ("OK", ""), "3": ("FAIL", "'gone'")}
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, label string")
    sinks.json_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        sinks.json_report(df, str(tmp_path / "j2"), most=1)
    sinks.csv_report(df, str(tmp_path / "csv"), raw="label")
    assert {r.label for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"a b", None}
    sinks.full_refresh(df, str(tmp_path / "t"))
    sinks.full_refresh(df.limit(1), str(tmp_path / "t"))
    assert versions.Table(spark, str(tmp_path / "t")).read().count() == 1
    assert [r.json for r in sinks.json_column(df.filter("id = 1")).collect()] == ['{"id":1,"label":"a,b"}'] and "| 1 | a,b |" in sinks.markdown_table(df)


def test_more_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.PY").write_text("x")
    (tmp_path / "src" / "b.bin").write_bytes(b"x")
    (tmp_path / "docs" / "c.py").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff")
    name = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert name(files.texts(spark, str(tmp_path), [".py", ".md"], ["docs"])) == ["a.PY"] and name(files.texts(spark, str(tmp_path), [".py"], [], keep_bad=True)) == ["a.PY", "bad.py", "c.py"]
    assert name(files.texts(spark, str(tmp_path / "docs"), [".py"], ["docs"])) == ["c.py"]  # only the path below counts
    (tmp_path / "log.csv").write_text("path,aligned_rev,aligned_at,aligned_by\na.md,3,t,me\n")
    assert tuple(files.alignment_log(spark, str(tmp_path / "log.csv")).first()) == ("a.md", "3", "t", "me")
    (tmp_path / "x.jsonl").write_text('{"title": "T", "branch_id": 4}\n{"title": "U"}\n')
    assert sorted(map(tuple, files.jsonl(spark, str(tmp_path / "x.jsonl"), "title string, branch_id int").collect())) == [("T", 4), ("U", None)]
    (tmp_path / "plan.json").write_text('{"run_id": "r", "mode": "apply", "root": "x",\n "changes": [{"file": "f", "rule_id": "R", "severity": "ERROR", "action": "report_only", "detail": {"a": "b"}, "safe_autofix": false}]}')
    r = files.plan(spark, str(tmp_path / "plan.json")).first()
    assert (r.run_id, r.file, r.detail, r.safe_autofix) == ("r", "f", {"a": "b"}, False)


def test_controls_and_labels(spark):
    docs = spark.createDataFrame([("x/risk_policy.md", None), ("y.md", "Risk review of policy")], "path string, title string")
    controls = spark.createDataFrame([("I", i, f"c{i}", t) for i, t in enumerate(["risk policy", "risk", "policy risk", "nothing", "review"] + ["risk"] * 5)] + [("N", 1, "n1", "policy")], "standard_code string, seq int, control_id string, title string")
    got = [tuple(r) for r in matching.map_controls(docs, controls, 0.05).orderBy("path", "standard_code", "rank").collect()]
    assert got[:6] == [("x/risk_policy.md", "I", "c0", 1.0, 1), ("x/risk_policy.md", "I", "c2", 1.0, 2), ("x/risk_policy.md", "I", "c1", 0.5, 3), ("x/risk_policy.md", "I", "c5", 0.5, 4), ("x/risk_policy.md", "I", "c6", 0.5, 5), ("x/risk_policy.md", "N", "n1", 0.5, 1)]
    assert got[6] == ("y.md", "I", "c0", 0.6667, 1)
    x = spark.createDataFrame([(2, "section::1. Cel"), (1, "section::CEL "), (3, "section::Żółć"), (4, "doc::x")], "id int, ref string")
    s = spark.createDataFrame([("cel",), ("zołc",), ("zołc",)], "heading_norm string")
    assert {r.label: (r.first_id, r.raw, r.n, r.status) for r in links.label_audit(x, s).collect()} == {"cel": (1, "CEL", 1, "unique"), "zołc": (3, "Żółć", 2, "ambiguous")}


@pytest.mark.parametrize("value,want", [(None, None), ("", None), ("[bad", "bad JSON"), ('{"a":1}', "not a list"), ('["x"]', None), ("3", "not a list")])
def test_json_errors(spark, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(T.json_list_error("x").alias("e")).first().e == want


def test_heading_forms(spark):
    df = spark.createDataFrame([("# A\n##B\n## C d\n```\n# in code\n```\n####### no\n",)], "x string")
    got = df.select(*(T.headings_of(F.col("x"), f).alias(f) for f in T.HEADING_FORMS)).first()
    assert (got["all"], got["second"], got["loose"]) == (["A", "C d", "in code"], ["C d"], ["A", "B", "C d", "in code"])


def test_server(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from docloom import server

    m = spark.createDataFrame([(1, "a/b.md", "I", "R", 0.6), (2, "c.md", "I", "R", None)], "id long, doc_path string, standard_code string, match_reason string, confidence double")
    m.write.parquet(str(tmp_path / "mapping.parquet"))
    http = server.serve(server.Application(spark, str(tmp_path), "secret"), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(path, body=None, token=None):
        r = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(r, timeout=60) as x:
                return x.status, json.load(x)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert ask("/health") == (200, {"status": "ok", "total_mappings": 2, "null_confidence": 1})
        assert [x["doc_path"] for x in ask("/templates?standard=I&limit=5")[1]] == ["a/b.md"] and ask("/templates?limit=501")[0] == 422
        assert ask("/coverage/I")[1]["pct"] == 50.0 and ask("/coverage/none")[0] == 404 and ask("/nothing")[0] == 404
        assert ask("/mappings/a%2Fb.md")[1][0]["standard_code"] == "I" and ask("/mappings/x")[0] == 404 and ask("/violations") == (200, [])
        assert ask("/review", {"mapping_id": 2, "approved": True})[0] == 401 and ask("/review", {"approved": True}, "secret")[0] == 422 and ask("/review", {"mapping_id": 9, "approved": True}, "secret")[0] == 404
        assert ask("/review", {"mapping_id": 2, "approved": True}, "secret") == (200, {"mapping_id": 2, "action": "approved", "new_confidence": 0.8, "new_match_reason": "expert_reviewed"})
        assert ask("/review", {"mapping_id": 1, "approved": False}, "secret")[1]["action"] == "rejected"
        assert spark.read.parquet(str(tmp_path / "decisions.parquet")).count() == 2
    finally:
        http.shutdown()


def test_policy(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("commands:\n  build:\n    - python3\n    - x.py\n")
    assert files.policy(spark, str(tmp_path / "p.yaml")) == {"commands": {"build": ["python3", "x.py"]}}
