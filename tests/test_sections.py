"""Small cases of sections, tables of roles, packages, repair and services."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import unicode as U
from docloom.operators import packages, raci, sections, services

TEXT = "# T\n## A\nx\nx\ny\n## B\nz\n"


@pytest.mark.parametrize(
    "args,want",
    [
        (("A", "append", "w"), "# T\n## A\nx\nx\ny\nw\n## B\nz\n"),
        (("A", "prepend", "w"), "# T\n## A\nw\nx\nx\ny\n## B\nz\n"),
        (("A", "replace", "w"), "# T\n## A\nw\n## B\nz\n"),
        (("A", "replace", "w", "x"), "# T\n## A\nw\nw\ny\n## B\nz\n"),
        (("A", "delete"), "# T\n## B\nz\n"),
        (("B", "rename", "C"), "# T\n## A\nx\nx\ny\n## C\nz\n"),
        (("A", "deduplicate"), "# T\n## A\nx\ny\n## B\nz\n"),
        (("Q", "delete"), TEXT),
    ],
)
def test_patch(spark, args, want):
    assert spark.createDataFrame([(TEXT,)], "text string").select(sections.patch("text", *args)).first()[0] == want


def test_unknown_operation():
    with pytest.raises(ValueError):
        sections.patch("text", "A", "swap")


def test_roles(spark):
    text = "|a|b|\n| Zadanie | Akceptuje | | Informed |\n|---|---|---|---|\n| Do it | X | | Y |\n|only|\n\n| z | z |"
    rows = raci.table_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert [tuple(r)[2:] for r in rows] == [("Do it", "X", "X", "", "Y")]


@pytest.mark.parametrize("text,want", [("---\na: 1\nb: c: d\na: 2\n---\nx", {"a": "2", "b": "c: d"}), ("---\na: 1\n", None), ("x", None), ("---\n---\n", {}), (None, None)])
def test_front_matter(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(sections.front_matter("text")).first()[0] == want


def test_packages(spark):
    counts = spark.createDataFrame([(f"{i:02}", "t", n) for i, n in enumerate((5, 5, 1, 9, 10, 2))], "code string, tag string, n long")
    got = {r.code: r.package for r in packages.packages(counts, 3).collect()}
    assert got == {"00": 1, "01": 1, "02": 1, "03": 2, "04": 3, "05": 3}
    assert packages.markdown(packages.packages(counts, 3)).count() == 3
    assert packages.packages(counts.limit(0), 3).isEmpty()


def test_repair(spark):
    df = spark.createDataFrame([("zażółć".encode().decode("cp1252", "ignore"),), ("é".encode().decode("cp1252"),), ("plain",), (None,)], "x string")
    got = [tuple(r) for r in U.repair(df, ["x"]).collect()]
    assert got[1:] == [("é", True), ("plain", False), (None, False)]


def test_profiles():
    legacy = set(services.PROFILES["legacy-runtime"])
    assert services.detect(legacy) == ("legacy-runtime", [])
    assert services.detect(legacy - {"flags"}) == ("unknown", ["flags"])
    with pytest.raises(RuntimeError):
        services.require(set(), "legacy-runtime")


def test_contract_and_doctor(spark, tmp_path):
    c = spark.createDataFrame([("u", 1, '["a"]', None)], "scope_uid string, version int, inputs_json string, outputs_json string")
    assert tuple(services.contract(c, "u").first()) == ("u", 1, ["a"], [])
    with pytest.raises(services.QueryError):
        services.contract(c, "v")
    policy = {"commands": {"build": ["python3", str(tmp_path / "build.py"), "--db"]}}
    found = services.doctor(spark, {"current": "legacy-runtime"}, {"there": str(tmp_path), "gone": str(tmp_path / "x")}, policy)
    assert {r.check: r.status for r in found.collect()} == {"current": "FAIL", "there": "OK", "gone": "FAIL", f"policy: {tmp_path / 'build.py'}": "FAIL"}
    assert services.exit_code(found, True) == 1 and services.exit_code(found, False) == 0 == services.exit_code(found.filter("check = 'there'"), True)


def test_phase_bullets(spark):
    text = "# T\n- Faza 1: outside\n## Fazy cyklu życia\n- Faza 1: Plan: more\n* faza 12 :  Do \n- Faza x: no\n- Faza 3:\n## Next\n- Faza 2: outside"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = sorted(tuple(r) for r in sections.phase_bullets(docs).collect())
    assert got == [(1, 4, 7, 3, "Faza 1: Plan", "phase-01", 1, "placeholder"), (1, 5, 7, 3, "Faza 12: Do", "phase-12", 1, "placeholder")]
    assert sections.phase_bullets(docs.filter("doc_id > 3")).isEmpty()


def test_snake_slug(spark):
    cases = {"Zażółć Gęślą": "zazolc_gesla", "ŁÓDŹ – plan #2": "lodz_plan_2", "Crème brûlée": "creme_brulee", "漢字": "", "a漢b": "ab", "": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", U.snake_slug(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases
