"""The tables' schemas: one declaration each, empty tables made from them, and older tables read through them.

A column that an older table lacks is null, one that has drifted to another name is read
under its own, and a type is cast where a value can be (null where it can't).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the profiles' tables.
_WHEN = "created_at_utc string, updated_at_utc string"
TABLES = {
    "current-snapshot": {
        "documents_current": f"id long, path string, title string, title_norm string, source string, status string, aligned int, aligned_at_utc string, aligned_by string, hash_sha256 string, hash_sha256_v2 string, template_id string, encoding_issue int, {_WHEN}",
        "documents_snapshot": "id long, snapshot_id long, path string, title string, title_norm string, source string, hash_sha256_v2 string",
        "anomalies_current": "id long, kind string, path string, detail string, created_at_utc string",
        "document_tags_current": "document_id long, tag_type string, tag_value string",
        "snapshots": "id long, created_at_utc string, note string",
        "current_build": "id long, built_at_utc string, note string",
        "runs": "id long, run_id string, started_at_utc string, finished_at_utc string, status string",
        "path_transitions": "id long, from_path string, to_path string, transition_kind string, snapshot_id long",
    },
    "legacy-runtime": {
        "docs": f"doc_uid string, title string, title_norm string, path string, origin string, {_WHEN}",
        "sections": "section_uid string, doc_uid string, heading_text string, heading_norm string, heading_level int, heading_path string, anchor string, ordinal int, status string, text_fingerprint_sha256 string, start_line int, end_line int",
        "standards": "standard_code string, standard_name string",
        "compliance_regulations": "regulation_code string, regulation_name string",
        "content_links": "id long, from_type string, from_ref string, to_type string, to_ref string, link_type string, direction string, rationale string, required int, source string, context_doc_uid string",
        "content_links_resolved": "content_link_id long, from_kind string, from_uid string, to_kind string, to_uid string, link_type string, direction string, rationale string, strength string, resolution_method string, resolution_confidence double, notes string",
        "rhythm_edges": "edge_id string, from_node string, to_node string, rhythm_type string, weight double, conditions string, version_range string, notes string",
        "contracts": f"contract_id string, scope_kind string, scope_uid string, version string, inputs_json string, outputs_json string, gates_json string, impact_json string, owner string, notes string, {_WHEN}",
        "flags": "flag string, value string",
        "_schema_version": "version long, applied_at_utc string",
    },
    "other": {
        "mapping": "doc_path string, standard_code string, match_reason string, confidence double",
        "regulation_mapping": "doc_path string, regulation_code string, match_reason string, confidence double",
        "template_violations": "template_path string, violation_type string, severity string, source_dir string",
        "edges": "edge_uid string, from_kind string, from_uid string, to_kind string, to_uid string, link_type string, direction string, rationale string, strength string, impact_area string, impact_level string, source string, source_row_id long",
        "gap_analysis": "id long, doc_title string, matched_doc_title string, matched_doc_path string, standard_code string, category string, gap_type string, confidence double, is_required int, notes string",
        "standards_catalog": "standard_code string, item_code string, title string, is_required int, category string, description string, keywords string",
        "sync_runs": "sync_id string, ran_at_utc string, kind string, status string, notes string",
    },
}
#: Names that columns have had, by table and column.
DRIFTED = {
    ("standards", "standard_code"): ("code",),
    ("standards", "standard_name"): ("name", "title"),
    ("compliance_regulations", "regulation_code"): ("code",),
    ("template_violations", "template_path"): ("path",),
    ("gap_analysis", "matched_doc_title"): ("matched_title",),
    ("content_links", "from_ref"): ("from_doc",),
    ("content_links", "to_ref"): ("to_doc",),
}


def schema(name: str) -> T.StructType:
    """The schema of a table."""
    for tables in TABLES.values():
        if name in tables:
            return T.StructType.fromDDL(tables[name])
    raise KeyError(f"no table {name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table with its declared columns: drifted names mended, missing columns null, types cast; further columns stay behind them.

    If a column and a former name of it are both there, the former name fills the column's nulls.
    """
    there = {c.lower(): c for c in df.columns}
    out, used = [], set()
    for f in schema(name).fields:
        names = [there[n] for n in (f.name, *DRIFTED.get((name, f.name), ())) if n in there]
        used |= set(names)
        kind = f.dataType.simpleString()
        values = [F.expr(f"try_cast(`{n}` AS {kind})") for n in names]
        out.append((F.coalesce(*values) if values else F.lit(None).cast(kind)).alias(f.name))
    return df.select(*out, *(F.col(f"`{c}`") for c in df.columns if c not in used))


def adopt(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Old and new rows of a table whose versions have different columns."""
    return conform(old, name).unionByName(conform(new, name), allowMissingColumns=True)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet`` as it is declared, whatever files of older shapes it holds."""
    return conform(spark.read.option("mergeSchema", True).parquet(f"{root.rstrip('/')}/{name}.parquet"), name)


def bootstrap(spark: SparkSession, root: str, profile: str) -> list[str]:
    """Make the tables of a profile that aren't there, empty and typed; their paths."""
    made = []
    for name in TABLES[profile]:
        path = f"{root.rstrip('/')}/{name}.parquet"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], schema(name)).write.parquet(path)
            made.append(path)
    return made
