"""Mixing sources to target weights.

The token shares of the sources are raised to an exponent, which is bisected until
the weights reach a target entropy or no source is repeated more often than a
limit. The weights become token budgets; each source's documents are permuted once
per epoch and dealt into blocks, so that every block has the target mixture.

No task sees a whole source: positions in a permutation come from prefix sums over
buckets of the permutation's hash. Sums over sources are aggregates, so no list of
sources reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import inner
from .store import discard, materialize

BUCKET_ROWS = 1_000
SECTIONS = 32  # exponents tried at once


def bisect_exponent(moments, tokens: float, least: float, most: float, repetition_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1]: that of the target entropy, or the smallest that keeps to the limit (1 if none does).

    ``tokens``: of all sources; ``least``, ``most``: of the smallest and the largest that has
    any. ``moments(exponents)``: for each the sum of the shares' powers, and that of powers
    times logarithms. Both goals fall as the exponent grows, and the smallest source is
    the one that is repeated most, so no more is needed.
    """

    def flat_enough(exponents: list[float]) -> list[bool]:  # true for small exponents
        if target_entropy is not None:
            return [math.log(z) - a * x / z >= target_entropy for a, (z, x) in zip(exponents, moments(exponents), strict=True)]
        if budget is not None:
            passes = [budget * (least / tokens) ** a / z / least for a, (z, _) in zip(exponents, moments(exponents), strict=True)]
        else:
            passes = [(most / least) ** (1 - a) for a in exponents]
        return [x > repetition_limit * (1 + 1e-12) for x in passes]

    if (target_entropy is None and repetition_limit is None) or not tokens:
        return 1.0
    low, high = flat_enough([0.0, 1.0])
    if not low:
        return 0.0
    if high:
        return 1.0
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-15:
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        n = sum(flat_enough(grid))
        new = (grid[n - 1] if n else lo, grid[n] if n < len(grid) else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return hi if target_entropy is None else lo


def plan(sizes: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source key, tokens, docs) -> the same with weight, passes and alpha. Sums over sources are DataFrame aggregates, so there may be many."""
    some = F.col("tokens") > 0
    all_, least, most = sizes.agg(F.sum("tokens"), F.min(F.when(some, F.col("tokens"))), F.max("tokens")).first()
    all_ = float(all_ or 0)
    share = F.col("tokens") / F.lit(all_ or 1.0)

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        power = [F.pow(share, F.lit(a)) for a in exponents]
        got = sizes.filter(some).agg(*(F.sum(x) for x in power), *(F.sum(x * F.log(share)) for x in power)).first()
        return list(zip(got[: len(exponents)], got[len(exponents) :], strict=True))

    alpha = bisect_exponent(moments, all_, least or 1, most or 1, repetition_limit, target_entropy, budget)
    weight = F.when(some, F.pow(share, F.lit(alpha)) / F.lit(moments([alpha])[0][0] if all_ else 1.0)).otherwise(0.0)
    passes = weight * budget / F.col("tokens") if budget is not None else F.pow(F.lit(float(most or 1)) / F.col("tokens"), F.lit(1 - alpha))
    # A whole number of passes stays one.
    return sizes.withColumns({"weight": weight, "passes": F.when(some, F.round(passes, 9)).otherwise(1.0), "alpha": F.lit(alpha)})


def mix(docs: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = 1_000_000, seed: int = 0) -> DataFrame:
    """One row per copy of a document: doc_id, source, n_tokens, weight, epoch, block, position.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``; null texts have none. A null source is a
    source of its own. Without a ``budget`` every document comes at least once and
    sources are repeated to reach the weights; with one, sources over their budget
    are cut. The last pass over a source ends with the document that reaches its
    budget. Documents without tokens cost nothing: each comes once, in epoch 0, dealt
    over the blocks by hash. Repeated rows are documents of their own. A source without
    tokens has weight 0. An empty table gives an empty result; other columns are ignored.
    """
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", "source", key.alias("key"), words.alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "sizes")
    bare = F.col("n_tokens") == 0
    sizes = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.count_if(bare).alias("bare"))
    sizes = materialize(sizes, "sources")
    spec = materialize(plan(sizes, repetition_limit, target_entropy, budget), "plan")
    discard(sizes)
    total, docs_, bare_, most = spec.agg(F.sum(F.col("tokens") * F.col("passes")), F.sum("docs"), F.sum("bare"), F.max("docs")).first()
    n_blocks = max(1, math.ceil((total or 0) / block_tokens), math.ceil((bare_ or 0) / block_tokens))
    buckets = max(1, math.ceil((docs_ or 0) / BUCKET_ROWS))
    # The plan is sent to all tasks only if its written size allows it; a large source's rows are spread.
    copies = inner(rows, spec.drop("docs", "bare", "alpha"), ["key"], ["row"], most or 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(bare, 0).otherwise(F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0))))))
    # The hash as an unsigned number, in the order of the buckets; buckets in groups, so that no sum walks over a whole source.
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "doc_id", "row"), 1)
    copies = copies.withColumn("u", u).withColumn("bucket", F.least(F.floor(F.col("u") / float(1 << 63) * buckets), F.lit(buckets - 1)).cast("int"))
    copies = copies.withColumn("group", F.floor(F.col("bucket") / BUCKET_ROWS).cast("int"))
    none = F.lit(0).cast("long")
    so_far = lambda by, order: F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), none)
    whole, part, leaf = ["key", "epoch"], ["key", "epoch", "group"], ["key", "epoch", "group", "bucket"]
    sums = copies.groupBy(*leaf).agg(F.sum("n_tokens").alias("n_tokens"))
    upper = sums.groupBy(*part).agg(F.sum("n_tokens").alias("n_tokens")).select(*part, so_far(whole, ["group"]).alias("before_group"))
    sums = sums.select(*leaf, so_far(part, ["bucket"]).alias("before")).join(upper, part).select(*leaf, (F.col("before") + F.col("before_group")).alias("before"))
    placed = copies.withColumn("own", so_far(leaf, ["u", "row"])).join(sums, leaf)
    here = F.col("epoch") * F.col("tokens") + F.col("own") + F.col("before")  # tokens of this source before this copy
    goal = F.col("passes") * F.col("tokens")
    placed = placed.filter(bare | (here < goal))
    order = F.xxhash64(F.lit(seed), F.lit("block"), "epoch", "doc_id", "row")
    block = F.when(bare, F.pmod(F.xxhash64(order), F.lit(n_blocks))).otherwise(F.least(F.floor(here / goal * n_blocks), F.lit(n_blocks - 1)))
    placed = placed.withColumn("block", block.cast("int"))
    placed = placed.withColumn("position", F.row_number().over(Window.partitionBy("block").orderBy(order, "row", "epoch")) - 1)
    return placed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")
