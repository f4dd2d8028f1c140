"""Bounded traversal and node-space operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import sinks, versions

from . import quality


def downstream(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, distance) reached from start (node) within ``depth`` steps, each at its least distance.

    One equi-join a step on the frontier alone; nodes seen before go by an anti-join.
    """
    seen = start.select(F.col("node"), F.lit(0).alias("distance")).distinct()
    front = seen
    e = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next")).distinct()
    for d in range(1, depth + 1):
        step = front.join(e, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        seen, front = seen.unionByName(step), step
    return seen.filter("distance > 0")


def upstream(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    return downstream(edges.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")), start, depth)


def walk(edges: DataFrame, start: DataFrame, depth: int = 2, up: bool = False) -> DataFrame:
    """The edges of a traversal: distance, from_node, to_node, edge_type. ``up`` follows edges backwards.

    An edge counts at the distance of the node that it is reached from, plus one; edges
    (from_node, to_node, edge_type) may be repeated by type.
    """
    e = edges.select("from_node", "to_node", "edge_type").distinct()
    near, far = ("to_node", "from_node") if up else ("from_node", "to_node")
    reached = start.select("node", F.lit(0).alias("distance")).distinct()
    if depth > 1:
        reached = reached.unionByName(downstream(e.select(F.col(near).alias("from_node"), F.col(far).alias("to_node")), start, depth - 1))
    return reached.join(e, F.col("node") == F.col(near)).select((F.col("distance") + 1).alias("distance"), "from_node", "to_node", "edge_type")


def nodes(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """node_uid, kind, parent_node_uid, title: a node per document, and per section below its nearest section of a higher level or its document.

    sections (section_uid, doc_uid, heading, level, ordinal); a document's sections of level 2 are
    ``sec``, deeper ones ``subsec``.
    """
    above = quality.parents(sections.select("doc_uid", "ordinal", "level")).select("doc_uid", "ordinal", "parent", "kind")
    uid = sections.select("doc_uid", F.col("ordinal").alias("parent"), F.col("section_uid").alias("parent_uid"))
    x = sections.join(above, ["doc_uid", "ordinal"]).join(uid, ["doc_uid", "parent"], "left")
    sec = x.select(F.col("section_uid").alias("node_uid"), "kind", F.coalesce("parent_uid", "doc_uid").alias("parent_node_uid"), F.col("heading").alias("title"))
    return docs.select(F.col("doc_uid").alias("node_uid"), F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("parent_node_uid"), "title").unionByName(sec)


CELL = 256  # ends of a hub that meet in a cell, on either side
SLICE = 1 << 29  # pairs that are made at once, about
HEAVY = 1 << 16  # pairs and edges of a node that one row may hold
TASK = 1 << 22  # pairs and edges of a task, about
SENT = 1 << 19  # nodes with their numbers that are sent to every task
PREDECESSOR, ALGORITHM = "migrate_edges_manual", "infer_v1"


def two_hops(edges: DataFrame, cell: int = CELL) -> DataFrame:
    """Inferred edges: pairs two steps apart that have no edge of their own. The rule is our own.

    A node's incoming and outgoing edges are dealt into cells of about ``cell`` by ``cell``, each a key of
    the join: a hub's pairs spread over as many tasks as it has cells, and an edge is sent to a
    row or column of cells only.
    """
    e = edges.select("from_node", "to_node").distinct()
    # A node is one cell but for the hubs, so only these are looked up.
    hubs = _middles(e, cell).select("mid", "rows", "columns").filter("rows > 1 or columns > 1")
    looked = lambda x: x.join(hubs, "mid", "left").fillna(1, ["rows", "columns"])
    pairs = _pairs(_dealt(e, looked, *INTO).join(_dealt(e, looked, *OUT), ["mid", "r", "c"]))
    return pairs.join(e, ["from_node", "to_node"], "left_anti")


#: Of the edges into a node and out of it: the node, the other end, what deals an edge, and what it is repeated along.
INTO, OUT = ("to_node", "from_node", "rows", "columns"), ("from_node", "to_node", "columns", "rows")


def _middles(e: DataFrame, cell: int) -> DataFrame:
    """mid, n_in, n_out, rows, columns: the nodes with edges both in and out, and their cells."""
    share = lambda n: F.ceil(F.col(n) / cell).cast("int")
    into = e.groupBy(F.col("to_node").alias("mid")).agg(F.count(F.lit(1)).alias("n_in"))
    out = e.groupBy(F.col("from_node").alias("mid")).agg(F.count(F.lit(1)).alias("n_out"))
    return into.join(out, "mid").select("mid", "n_in", "n_out", share("n_in").alias("rows"), share("n_out").alias("columns"))


def _dealt(e: DataFrame, looked, mid: str, other: str, own: str, across: str) -> DataFrame:
    x = looked(e.select(F.col(mid).alias("mid"), F.col(other).alias(other)))
    mine = F.pmod(F.xxhash64(other), F.col(own)).cast("int").alias(own[0])
    return x.select("mid", other, mine, F.explode(F.sequence(F.lit(0), F.col(across) - 1)).alias(across[0]))


def _pairs(hop: DataFrame) -> DataFrame:
    return hop.filter("from_node <> to_node").select("from_node", "to_node").distinct()


def two_hops_by_slices(edges: DataFrame, folder: str, cell: int = CELL, most: int = SLICE, heavy: int = HEAVY) -> Iterator[DataFrame]:
    """The rows of ``two_hops`` in slices by the hash of from_node, of about ``most`` pairs before equal ones are merged.

    Pairs may be many times the edges, so they aren't shuffled: a middle's ends are one list, which goes along
    its incoming edges to their from_node and is merged there with the others. A from_node with more than
    ``heavy`` pairs and edges has no lists; its pairs are made distinct one by one, in slices of their own.
    Each slice has to be written before the next one is asked for; then the disk holds edges, one
    slice and the result. The edges, and the lists, are written to ``folder`` once.
    Only a single from_node with more than ``most`` pairs makes a slice larger.
    """
    e = versions.written(edges.select("from_node", "to_node").dropna().distinct(), f"{folder}/edges")
    ends = versions.written(e.groupBy(F.col("to_node").alias("mid")).agg(F.count(F.lit(1)).alias("n_in")), f"{folder}/ends")
    onward = versions.written(e.withColumnRenamed("from_node", "mid").join(_sent(ends.select("mid"), ends), "mid", "left_semi"), f"{folder}/onward")
    n_out = onward.groupBy("mid").agg(F.count(F.lit(1)).alias("n_out"))
    share = lambda n: F.ceil(F.col(n) / cell).cast("int")
    mids = versions.written(n_out.join(ends.hint("merge"), "mid").select("mid", "n_in", "n_out", share("n_in").alias("rows"), share("n_out").alias("columns")), f"{folder}/middles")
    sent = lambda *names: _sent(mids.select("mid", *names), mids)
    x = onward.join(sent("rows", "n_out").filter(F.col("n_out") <= heavy), "mid").groupBy("mid", "rows").agg(F.collect_list("to_node").alias("ends"))
    # By the size of its files it would be sent whole to the driver and every task, as the two below.
    lists = versions.written(x.select("mid", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "ends"), f"{folder}/lists").hint("merge")
    cost = e.withColumnRenamed("to_node", "mid").join(sent("n_out"), "mid", "left").groupBy("from_node").agg(F.sum(F.coalesce("n_out", F.lit(0)) + 1).alias("cost"))
    large = versions.written(cost.filter(F.col("cost") > heavy), f"{folder}/heavy").hint("merge")
    total = (mids.agg(F.sum(F.col("n_in") * F.col("n_out"))).first()[0] or 0) + e.count()
    many = large.agg(F.sum("cost")).first()[0] or 0
    for own, size in _sliced(e.join(large, "from_node", "left_anti") if many else e, total - many, most):
        yield _merged(own, lists, sent("rows"), size)
    if many:
        looked = lambda x: x.join(sent("rows", "columns"), "mid")
        out = versions.written(_dealt(e, looked, *OUT), f"{folder}/out").hint("merge")
        for own, _ in _sliced(e.join(large, "from_node", "left_semi"), many, most):
            yield _pairs(_dealt(own, looked, *INTO).join(out, ["mid", "r", "c"])).join(own.hint("merge"), ["from_node", "to_node"], "left_anti")


def _sent(x: DataFrame, known: DataFrame) -> DataFrame:
    """``x`` to be joined: whole to every task if ``known``, a table that was written, has few rows, else by sorted merge."""
    return F.broadcast(x) if known.count() <= SENT else x.hint("merge")


def _sliced(e: DataFrame, cost: int, most: int) -> Iterator[tuple[DataFrame, int]]:
    n = -(-max(cost, 1) // most)
    for i in range(n):
        yield e.filter(F.pmod(F.xxhash64("from_node", F.lit("slice")), F.lit(n)) == i) if n > 1 else e, -(-cost // n)


def _merged(own: DataFrame, lists: DataFrame, rows: DataFrame, cost: int) -> DataFrame:
    """The pairs of ``own`` from the ends of its middles: a from_node's lists meet in one row."""
    cells = own.withColumnRenamed("to_node", "mid").join(rows, "mid", "left")
    # Edges into a node without ends meet nothing, so any cell will do.
    near = cells.withColumn("r", F.pmod(F.xxhash64("from_node"), F.coalesce("rows", F.lit(1 << 30))).cast("int"))
    far = near.join(lists, ["mid", "r"], "left").select("from_node", "mid", "ends").repartition(1 + cost // TASK, "from_node")
    both = far.groupBy("from_node").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.collect_list("mid").alias("near"))
    return both.select("from_node", F.explode(F.array_except("ends", F.array_append("near", F.col("from_node")))).alias("to_node"))


def gate(log: DataFrame, kind: str) -> str | None:
    """Why a stage may not run after ``kind``: its last row of the run log is missing or a failure. Null if it may."""
    last = log.filter(F.col("kind") == kind).orderBy(F.desc("ran_at_utc"), F.desc("sync_id")).select("status").first()
    if last is None:
        return f"missing sync_runs kind={kind}"
    return f"sync_runs kind={kind} status={last.status}" if last.status == "FAIL" else None


def infer_edges(spark: SparkSession, edges: DataFrame, log: str, target: str, run_id: str, ran_at: str) -> DataFrame | None:
    """The stage that infers edges: gated on the run log, its result a version of ``target``, its own row in the log.

    If the predecessor isn't in the log, or failed, nothing is written and the row is a WARN with
    ``skip: gate:`` and why. Else it is OK with the gate, the number of new edges and the algorithm;
    FAIL if the work fails, and ``target`` keeps its former version.
    """
    why = gate(sinks.read_log(spark, log), PREDECESSOR)
    with sinks.logged(spark, run_id, ran_at, "graph_edges_inferred", log) as say:
        if why:
            say.skip(f"skip: gate: {why}")
            return None
        table = versions.Table(spark, target)
        with versions.temporary(spark, "edges") as folder:
            table.refresh_by(two_hops_by_slices(edges, folder), constant=("source", ALGORITHM))
        found = table.read()
        say.note(f"gate=ok inserted_total={found.count()} algorithm={ALGORITHM}")
    return found


def influence(edges: DataFrame) -> DataFrame:
    """Number and weight of edges at each node. The measure is our own."""
    both = edges.select(F.col("from_node").alias("node"), "weight").unionByName(edges.select(F.col("to_node").alias("node"), "weight"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.bround(F.sum("weight"), 4).alias("weight"))
