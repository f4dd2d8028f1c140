"""Commands over a folder of tables."""

from docloom import cli


def test_commands(spark, tmp_path, capsys):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("docs", [("a.md", "A"), ("b.md", "B")], "path string, title string")
    put("mapping", [("a.md", "ISO-1"), ("b.md", "ISO-2"), ("b.md", "X")], "doc_path string, standard_code string")
    put("edges", [("a", "b"), ("b", "c"), ("c", "d")], "from_node string, to_node string")
    put("contracts", [("a", 2, '["i"]')], "scope_uid string, version int, inputs_json string")
    run = lambda *a: cli.main(["--tables", str(tmp_path), *a], spark)
    assert run("find", "--standard", "ISO", "--limit", "1") == 0
    assert capsys.readouterr().out == "a.md  [ISO-1]  A\n... and 1 more\n"
    assert run("rhythm", "b") == 0
    assert capsys.readouterr().out == "upstream:\n  d=1  a --[]--> b\ndownstream:\n  d=1  b --[]--> c\n  d=2  c --[]--> d\n"
    assert run("contract", "a") == 0 and '"version": 2' in capsys.readouterr().out
    assert run("contract", "zz") == 1
    assert run("check") == 1
    (tmp_path / "x.md").write_text("no front\n")
    assert run("validate", str(tmp_path / "x.md")) == 1


def test_more_commands(spark, tmp_path, capsys):
    from docloom import cli

    def run(*args):
        code = cli.main(["--tables", str(tmp_path / "t"), *args], spark)
        return code, capsys.readouterr().out

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t" / f"{name}.parquet"))

    table("docs", [("a.md", "A"), ("b.md", "B")], "path string, title string")
    table("mapping", [("a.md", "ISO-1", None, "R"), ("a.md", "ISO-1", 0.9, "R")], "doc_path string, standard_code string, confidence double, match_reason string")
    table("standards", [("ISO-1", "words")], "standard_code string, description string")
    table("guided", [("a.md", "ISO-1")], "doc_path string, standard_code string")
    table("regulation_mapping", [("b.md", "RODO")], "doc_path string, regulation_code string")
    table("edges", [(1, 2, "needs"), (2, 3, "needs")], "from_node long, to_node long, edge_type string")
    assert run("find", "--regulation", "ROD") == (0, "b.md  [RODO]  B\n")
    assert run("rhythm", "2") == (0, "upstream:\n  d=1  1 --[needs]--> 2\ndownstream:\n  d=1  2 --[needs]--> 3\n")
    assert run("coverage") == (0, "ISO-1  1\n1 of 2 documents, 50.0%\n") and run("coverage", "--gaps", "--least", "1")[1].startswith("1 of 2")
    code, out = run("audit", "--ci", "--standard", "ISO-1")
    assert code == 0 and "null_confidence  1" in out and "OK  coverage ISO-1  100" in out
    assert run("backfill") == (0, "1 rows\n") and run("backfill", "--target", str(tmp_path / "filled"))[0] == 0 and spark.read.parquet(str(tmp_path / "filled")).filter("confidence is null").isEmpty()
    assert "| Mappings | 2 |" in run("report")[1]
    assert run("audit", "--ci", "--standard", "none")[0] == 1 and run("audit")[0] == 0
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("---\ntitle: T\n---\n## Cel dokumentu\n")
    assert run("fix", str(tmp_path / "md"), "--plan", str(tmp_path / "plan")) == (0, "ERROR  DOC.SECTION.MISSING  2 in 1 files\n") == run("review", str(tmp_path / "plan"))
    assert "+## Zakres i granice" in run("fix", str(tmp_path / "md"), "--mode", "dry-run", "--plan", str(tmp_path / "plan"))[1]
    assert run("fix", str(tmp_path / "md"), "--mode", "apply", "--plan", str(tmp_path / "plan"), "--target", str(tmp_path / "new"), "--backup", str(tmp_path / "old")) == (0, "changed  1\n")
    assert run("bootstrap")[1].count("made") == 8 and run("bootstrap") == (0, "") and run("check") == (0, "OK\n")
