"""Merkle manifest of a dataset: a trie over the ranks of documents within their language.

Ranks come from hierarchical histograms of the ids' digits. A leaf's rank, written in the
fanout's base, is its key; the nodes of a prefix are its children's digest. Longest
prefixes go first: a task reduces a run of ``fanout ** step`` leaves, ``step`` levels at
once, and the runs' nodes are the leaves of the next round. Paths then come down round by
round, each run meeting the path of its node, and every document is proved by folding its
own leaf with its siblings up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import materialize

FANOUT = 2
RUN = 1024  # leaves that a task reduces at once, at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """SHA-256 (lowercase hex) over the fields of a document; ``n_chars`` in place of its own."""
    return F.sha2(F.concat(*(field(n_chars if c == "n_chars" and n_chars is not None else F.col(c)) for c in FIELDS)).cast("binary"), 256)


def tampered_leaf(doc_id: str = "doc_id") -> Column:
    """The leaf, with one added to n_chars where 7 divides the CRC-32 of the decimal id (null ids aren't touched)."""
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0
    return F.when(chosen, leaf(F.try_add("n_chars", F.lit(1)))).otherwise(leaf())


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def reduce_run(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """A run's nodes level by level, from its leaves to one node."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree: list[list[str]], i: int, fanout: int) -> Iterator[tuple[str, str]]:
    """What stands before and behind leaf ``i``'s node in its group, level by level."""
    for nodes in tree[:-1]:
        first = i - i % fanout
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])
        i //= fanout


def fold(node: str, path: Iterator[tuple[str, str]]) -> str:
    for before, behind in path:
        node = sha256((before + node + behind).encode()).hexdigest()
    return node


def _step(fanout: int) -> int:
    """Levels of a round."""
    step = 1
    while fanout ** (step + 1) <= RUN:
        step += 1
    return step


def _levels(size: int, done: int, fanout: int, step: int) -> int:
    return min(step, height(size, fanout) - done)


def _up(nodes: DataFrame, done: int, fanout: int) -> DataFrame:
    """One round: (part, size, idx, node) -> the same for the nodes of runs; ``done`` levels came before."""
    step = _step(fanout)
    width = fanout**step

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("idx").to_pydict()
        top = reduce_run(t["node"], _levels(t["size"][0], done, fanout, step), fanout)[-1][0]
        return pa.table({"part": [key[0].as_py()], "size": t["size"][:1], "idx": [key[1].as_py()], "node": [top]})

    return nodes.withColumn("run", F.floor(F.col("idx") / width)).groupBy("part", "run").applyInArrow(run, "part string, size long, idx long, node string")


def _down(nodes: DataFrame, paths: DataFrame, done: int, fanout: int) -> DataFrame:
    """Paths of nodes: their siblings of this round, then those of the run's node. ``paths``: (part, run, path)."""
    step = _step(fanout)
    width = fanout**step

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t, above = left.sort_by("idx").to_pydict(), right.column("path").to_pylist()[0]
        tree = reduce_run(t["node"], _levels(t["size"][0], done, fanout, step), fanout)
        path = [[x for pair in siblings(tree, i, fanout) for x in pair] + above for i in range(len(t["idx"]))]
        return pa.table({"part": t["part"], "run": t["idx"], "path": pa.array(path, pa.list_(pa.string()))})

    keyed = nodes.withColumn("run", F.floor(F.col("idx") / width))
    return keyed.groupBy("part", "run").cogroup(paths.groupBy("part", "run")).applyInArrow(run, "part string, run long, path array<string>")


def _tree(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, the top node of each part)."""
    step = _step(fanout)
    most = height(nodes.agg(F.max("size")).first()[0] or 0, fanout)
    rounds, tops, done = [nodes], None, 0
    while True:
        up = materialize(_up(rounds[-1], done, fanout), "nodes")
        done += step
        reach = fanout**done  # a part with so many leaves has one node now
        top = up.filter(F.col("size") <= reach)
        tops = top if tops is None else tops.unionByName(top)
        if done >= most:
            return rounds, tops
        rounds.append(up.filter(F.col("size") > reach))


def _paths(rounds: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The paths of the runs of the first round. ``tops``: (part, path) above each part's top node."""
    step = _step(fanout)
    over = [fanout ** (step * (k + 1)) for k in range(len(rounds))]
    size = F.col("size")
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = tops.filter((size <= over[k]) & (size > (over[k - 1] if k else 0))).select("part", F.lit(0).cast("long").alias("run"), "path")
        if paths is not None:
            ends = ends.unionByName(materialize(_down(rounds[k + 1], paths, step * (k + 1), fanout), "paths"))
        paths = ends
    return paths


def prove(docs: DataFrame, claim: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Leaves ascend by doc_id within each lang, subroots by lang (null first, then by bytes).
    ``folded_root`` is what the leaf that a row claims gives with its siblings; ``claim`` is an
    expression over ``docs``, by default the leaf itself. Other columns are ignored. A null doc_id comes with the smallest possible one; rows that tie are ordered by leaf, and
    equal leaves by a number dealt beforehand. An empty table gives none.
    """
    own = leaf()
    # Null is the part '', others begin with '=': byte order puts null first.
    part = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", part.alias("part"), own.alias("node"), (own if claim is None else claim).alias("claim"))
    low = F.lit(-(2**63)).cast("long")
    rows = rows.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), low), "head": F.conv(F.substring("node", 1, 15), 16, 10).cast("long"), "row": F.monotonically_increasing_id()})
    rows = materialize(rows, "leaves")
    placed = ranked(rows, "part", ["id", "head", "row"], ["id", "node", "row"])
    step = _step(fanout)
    width = fanout**step
    leaves = materialize(placed.select("doc_id", "part", "size", F.col("rank").alias("idx"), "node", "claim"), "ranked")
    rounds, tops = _tree(leaves.select("part", "size", "idx", "node"), fanout)
    # The parts are leaves of the upper tree.
    blocks = {f"b{k}": F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode("part", "utf-8"), 7 * k + 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(0)) for k in range(3)}
    named = materialize(tops.select("part", "size", "node").withColumns({"all": F.lit("")} | blocks), "subroots")
    upper = ranked(named.select("all", "part", "node", *blocks), "all", list(blocks), ["part"])
    upper = materialize(upper.select(F.col("all").alias("part"), "size", F.col("rank").alias("idx"), "node", F.col("part").alias("name")), "parts")
    high, root = _tree(upper.select("part", "size", "idx", "node"), fanout)
    top = root.first()  # one row
    found = _down(high[0], _paths(high, root.select("part", "size", F.array().cast("array<string>").alias("path")), fanout), 0, fanout)
    found = upper.join(found.select(F.col("run").alias("idx"), "path"), "idx").select(F.col("name").alias("part"), "path")
    found = materialize(named.select("part", "size").join(found, "part"), "part-paths")
    paths = _paths(rounds, found, fanout)
    told = named.select("part", F.col("node").alias("subroot"), F.lit(top.node if top else None).cast("string").alias("root"))
    paths = paths.join(told, "part")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t, up = left.sort_by("idx"), right.to_pylist()[0]
        above = list(zip(up["path"][::2], up["path"][1::2], strict=True))
        tail = "".join(up["path"])
        nodes = t.column("node").to_pylist()
        tree = reduce_run(nodes, _levels(t.column("size")[0].as_py(), 0, fanout, step), fanout)
        proof, folded = [], []
        for i, claim in enumerate(t.column("claim").to_pylist()):
            path = list(siblings(tree, i, fanout))
            proof.append(sha256(("".join(a + b for a, b in path) + tail).encode()).hexdigest())
            folded.append(fold(claim, path + above))
        n = len(nodes)
        return pa.table({"doc_id": t.column("doc_id"), "leaf": nodes, "subroot": [up["subroot"]] * n, "root": [up["root"]] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == up["root"] for x in folded]})

    keyed = leaves.withColumn("run", F.floor(F.col("idx") / width))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.groupBy("part", "run").cogroup(paths.groupBy("part", "run")).applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
