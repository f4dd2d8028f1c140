"""Similarity of token sets by an inverted index: only pairs with a common token meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T


def _best(df: DataFrame, by: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank. Spark keeps k rows a group in each task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))).filter(F.col("rank") <= k)


HOT = 256  # sets that a token may be in before it counts as frequent
MOST_HOT = 4096  # the most frequent tokens are told apart, so many at most


def _frequent(sets: DataFrame) -> list[str]:
    n = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    return [r.t for r in n.orderBy(F.desc("n"), "t").limit(MOST_HOT).collect()]


def top_similar(left: DataFrame, right: DataFrame, least: float, k: int, repeats: bool = True, group: str | None = None) -> DataFrame:
    """left (a, tokens), right (b, tokens) -> a, b, score, rank: the k best b of each a, by Jaccard and then b.

    With ``group``, a column of right, the k best of each group. Rows with the same token set are worked off as one, so many equal titles cost one (on the left
    only with ``repeats``: long texts hardly repeat, and their tokens are then taken once).

    Sets meet token by token and overlaps are summed: no pair without a common token is
    ever made and no text travels. Tokens in very many sets of the right would still make the
    square of their frequency, so they aren't joined set by set. What a set has of them, and its size, is its class;
    classes meet instead, and each gives its k smallest b: sets that have nothing rarer in
    common with a score alike within a class, so its other members can't be among the best.
    """
    g, c = F.col("g"), F.col
    keyed = lambda x, *n: x.select(*n, F.array_sort("tokens").alias("tokens")).filter(F.size("tokens") > 0).withColumn("set", F.sha2(F.array_join("tokens", " ").cast("binary"), 256))
    r = keyed(right, "b", (F.lit("") if group is None else c(group)).alias("g")).withColumn("set", F.struct("set", "g"))
    l = keyed(left, "a") if repeats else left.select(c("a").alias("set"), "tokens")
    once = lambda x, *n: x.groupBy("set", *n).agg(F.any_value("tokens").alias("tokens"))
    xs, ys = once(l) if repeats else l, once(r, "g")
    members = _best(r.select(c("set").alias("y"), "b"), "y", ["b"], k).drop("rank")
    hot = _frequent(ys)
    common = F.lit(hot) if hot else F.array().cast("array<string>")

    def postings(x: DataFrame, s: str, *more: str) -> DataFrame:
        rare = F.array_except("tokens", common) if hot else c("tokens")
        own = [F.array_intersect("tokens", common).alias(f"h_{s}")] if hot else []
        return x.select(c("set").alias(s), F.size("tokens").alias(f"n_{s}"), *own, *more, F.explode(rare).alias("t"))

    facts = ["n_x", "n_y", "g", *(["h_x", "h_y"] if hot else [])]
    hits = postings(xs, "x").join(postings(ys, "y", "g"), "t").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.any_value(F.struct(*facts)).alias("f")).select("x", "y", "c", "f.*")
    if hot:
        hits = hits.withColumn("c", c("c") + F.size(F.array_intersect("h_x", "h_y")))
    score = c("c") / (c("n_x") + c("n_y") - c("c"))
    found = hits.select("x", "y", "g", score.alias("score")).filter(c("score") >= least).join(members, "y").select("x", "g", "b", "score")
    if hot:
        cls = lambda x, s, *more: x.select(F.array_intersect("tokens", common).alias(f"h_{s}"), F.size("tokens").alias(f"n_{s}"), *more).filter(F.size(f"h_{s}") > 0)
        cy = cls(ys.withColumnRenamed("set", "y").join(members, "y"), "y", "g", "b")
        cy = _best(cy, ["h_y", "n_y", "g"], ["b"], k).groupBy("h_y", "n_y", "g").agg(F.array_sort(F.collect_list("b")).alias("bs"))
        own = cls(xs, "x", c("set").alias("x"))
        met = own.select("h_x", "n_x").distinct().withColumn("t", F.explode("h_x")).join(cy.withColumn("t", F.explode("h_y")), "t")
        met = met.groupBy("h_x", "n_x", "h_y", "n_y", "g").agg(F.count(F.lit(1)).alias("c"), F.any_value("bs").alias("bs"))
        met = met.select("h_x", "n_x", "g", score.alias("score"), F.explode("bs").alias("b")).filter(c("score") >= least)
        met = _best(met, ["h_x", "n_x", "g"], [F.desc("score"), "b"], k).drop("rank")
        found = found.unionByName(own.join(met, ["h_x", "n_x"]).select("x", "g", "b", "score"))
        found = found.groupBy("x", "g", "b").agg(F.max("score").alias("score"))
    best = _best(found, ["x", "g"], [F.desc("score"), "b"], k)
    shown = ["b", "score", "rank"] if group is None else [g.alias(group), "b", "score", "rank"]
    if not repeats:
        return best.select(c("x").alias("a"), *shown)
    return l.select("a", c("set").alias("x")).join(best, "x").select("a", *shown)


def map_controls(docs: DataFrame, controls: DataFrame, least: float = 0.05, k: int = 5) -> DataFrame:
    """docs (path, title or null), controls (standard_code, seq, control_id, title) -> for each document and standard the k most similar controls.

    path, standard_code, control_id, confidence to four digits, rank; ties by seq. A document without a
    title goes by its file's name. Documents meet controls by their words; the standard only ranks.
    """
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), T.title_of_path(F.col("path")))
    left = docs.select(F.col("path").alias("a"), T.control_words(name).alias("tokens"))
    right = controls.select(F.struct("seq", "control_id").alias("b"), "standard_code", T.control_words("title").alias("tokens"))
    near = top_similar(left, right, least, k, group="standard_code")
    return near.select(F.col("a").alias("path"), "standard_code", "b.control_id", F.bround("score", 4).alias("confidence"), "rank")


def keyword_rules(docs: DataFrame, rules: list[tuple[str, str]], key: str, text: str) -> DataFrame:
    """Codes whose keyword occurs in a document, any case, sorted and distinct. Rules are a short list in the plan."""
    low = F.lower(text)
    codes = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(k.lower()), F.lit(c)) for k, c in rules)))))
    return docs.select(key, F.array_join(codes, ",").alias("codes")).filter("codes <> ''")
