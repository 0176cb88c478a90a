"""Placement of representative meters: size classes, scores, and a round robin over branches.

Loads are rows of name, bus, base_kw, load_seq (their order). A strategy is a function from loads and a network to loads.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import graph
from gridloom.operators.order import numbered, quantiles
from gridloom.sources.shared import staged

#: Weights of size, depth, downstream load and backbone, whose flag counts 1.5; they sum to more than 1 (fixed values).
WEIGHTS = (0.30, 0.20, 0.40, 0.20)
BACKBONE = 1.5
#: What a load on a bus that can't be reached has (fixed values).
NO_DEPTH, NO_BRANCH = 999, -1


class PlacementStrategy(Protocol):
    def select(self, loads: DataFrame, network: DataFrame, source: str) -> DataFrame: ...


def quartiles(loads: DataFrame, value: str = "base_kw") -> DataFrame:
    """One row q: the exact quartiles, interpolated linearly; null without loads."""
    return loads.sparkSession.createDataFrame([(quantiles(loads, value, (0.25, 0.5, 0.75)),)], "q array<double>")


def size_classed(loads: DataFrame) -> DataFrame:
    kw = F.col("base_kw")
    named = F.when(kw <= F.col("q")[0], "Small").when(kw <= F.col("q")[1], "Medium").when(kw <= F.col("q")[2], "Large").otherwise("Very Large")
    return loads.crossJoin(F.broadcast(quartiles(loads))).withColumn("size_class", named).drop("q")  # one row


def attached(loads: DataFrame, tree: DataFrame, sums: DataFrame, backbone: DataFrame, branch: DataFrame) -> DataFrame:
    """loads with downstream_kw, downstream_score, depth, branch, on_backbone; what a bus lacks has its default."""
    bus = tree.select("node", "depth").join(sums, "node").join(branch, "node").join(backbone.select("node", F.lit(True).alias("on_backbone")), "node", "left")
    greatest = F.broadcast(sums.agg(F.max("downstream").alias("_most")))  # one row
    out = loads.join(bus, F.col("bus").cast("string") == F.col("node"), "left").drop("node").crossJoin(greatest)
    return out.select(
        *loads.columns,
        F.coalesce("downstream", F.lit(0.0)).alias("downstream_kw"),
        (F.coalesce("downstream", F.lit(0.0)) / F.nullif(F.col("_most"), F.lit(0.0))).alias("downstream_score"),
        F.coalesce("depth", F.lit(NO_DEPTH)).alias("depth"),
        F.coalesce("branch", F.lit(NO_BRANCH)).alias("branch"),
        F.coalesce("on_backbone", F.lit(False)).alias("on_backbone"),
    )


def score(most_depth: Column) -> Column:
    size, depth, down, spine = WEIGHTS
    return size * F.least(F.col("base_kw") / 100.0, F.lit(1.0)) + depth * F.col("depth") / F.nullif(most_depth, F.lit(0)) + down * F.col("downstream_score") + spine * F.when(F.col("on_backbone"), BACKBONE).otherwise(0.0)


def scored(loads: DataFrame) -> DataFrame:
    most = F.broadcast(loads.agg(F.max("depth").alias("_most")))  # one row
    return loads.crossJoin(most).withColumn("score", score(F.col("_most"))).drop("_most")


def round_robin(loads: DataFrame, target: int) -> DataFrame:
    """loads chosen, with `pick` (their order): in each size class, by first appearance, one load of each branch in turn, best scores first,
    no bus twice, until the class's share of target (halves to even, 1 at least) is met.

    A class can choose from its first branches only, and from their best buses, as many as all classes choose together and its own share: what else there is is left out
    for all classes at once, before they choose one after another.
    """
    classes = loads.groupBy("size_class").agg(F.min("load_seq").alias("first"), F.count("*").alias("n")).orderBy("first").collect()  # four rows at most
    whole = sum(r["n"] for r in classes)
    quotas = [max(1, round(target * r["n"] / whole)) for r in classes]
    most = sum(quotas) + max(quotas, default=1)
    turns = loads.groupBy("size_class", "branch").agg(F.min("load_seq").alias("_turn"))
    first = turns.withColumn("_t", F.row_number().over(W.partitionBy("size_class").orderBy("_turn"))).filter(F.col("_t") <= most).drop("_t")
    best = loads.groupBy("size_class", "bus").agg(F.max_by(F.struct(*loads.columns), F.struct("score", -F.col("load_seq"))).alias("l")).select("l.*")
    by_score = W.partitionBy("size_class", "branch").orderBy(F.desc("score"), "load_seq")
    near = best.join(first, ["size_class", "branch"]).withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= most)
    near = staged(near.select(*loads.columns, "_turn"))
    chosen = near.filter(F.lit(False)).withColumns({"_class": F.lit(0), "_round": F.lit(0)})
    for k, (r, quota) in enumerate(zip(classes, quotas, strict=True)):
        own = near.filter(F.col("size_class") == r["size_class"]).join(chosen.select("bus"), "bus", "left_anti")
        ranked = own.withColumn("_round", F.row_number().over(W.partitionBy("branch").orderBy(F.desc("score"), "load_seq")))
        picked = ranked.orderBy("_round", "_turn").limit(quota).select(*near.columns, F.lit(k).alias("_class"), "_round")
        chosen = chosen.unionByName(staged(picked))
    counts = {r["_class"]: r["count"] for r in chosen.groupBy("_class").count().collect()}
    before = F.lit(0)
    for k in range(1, len(classes)):
        before = F.when(F.col("_class") == k, sum(counts.get(j, 0) for j in range(k))).otherwise(before)
    place = F.row_number().over(W.partitionBy("_class").orderBy("_round", "_turn"))  # a class's share of target
    out = chosen.withColumn("pick", (place - 1 + before).cast("long")).select(*loads.columns, "pick")
    return truncated(out, target) if sum(counts.values()) > target else out


def truncated(chosen: DataFrame, target: int) -> DataFrame:
    """The best `target` by score if there are more, in that order."""
    if chosen.count() <= target:
        return chosen
    top = chosen.orderBy(F.desc("score"), "pick").limit(target)
    return numbered(top.withColumnRenamed("pick", "_p"), F.desc("score"), "_p", name="pick").drop("_p")


def balanced(chosen: DataFrame) -> DataFrame:
    """Where phases or connections would be balanced; leaves the choice as it is."""
    return chosen


def meters(chosen: DataFrame) -> DataFrame:
    """The chosen loads numbered M001, M002 and so on."""
    return chosen.select(F.format_string("M%03d", (F.col("pick") + 1).cast("long")).alias("meter_id"), F.col("name").alias("load_name"), "bus", "base_kw", "branch", "depth", "downstream_kw", "size_class", "on_backbone")


class HybridPlacement:
    """Classes, tree, roll-up, main path, branches, scores and round robin in turn. `digits` rounds downstream loads and scores, so that equal ones tie whatever the order of sums was."""

    def __init__(self, target: int = 49, digits: tuple[int, int] | None = None) -> None:
        self.target, self.digits = target, digits

    def select(self, loads: DataFrame, network: DataFrame, source: str) -> DataFrame:
        """loads chosen from loads and network's edges (src, dst)."""
        return round_robin(self.scored(loads, network, source), self.target).transform(balanced).transform(balanced)

    def scored(self, loads: DataFrame, network: DataFrame, source: str) -> DataFrame:
        """All loads with what the choice goes by."""
        tree = self.tree(graph.contracted(graph.adjacency(network)), source)
        values = loads.select(F.col("bus").cast("string").alias("bus"), "base_kw")
        sums = graph.rolled_up(tree, values, "bus", {"base_kw": "downstream"})
        sums = staged(sums.withColumn("downstream", F.round("downstream", self.digits[0])) if self.digits else sums)
        out = scored(attached(size_classed(loads), tree, sums, graph.main_path(tree, sums), graph.branches(tree)))
        return staged(out.withColumn("score", F.round("score", self.digits[1])) if self.digits else out)

    def tree(self, near: DataFrame, source: str) -> DataFrame:
        """A tree is rooted in rounds by its logarithm; a graph with cycles breadth first, level by level."""
        try:
            return graph.rooted_tree(near, source)
        except ValueError:
            return graph.rooted(near, source)


def summary(chosen: DataFrame) -> DataFrame:
    """One row of totals and averages of the chosen loads."""
    return chosen.agg(F.count("*").alias("n"), F.countDistinct("branch").alias("branches"), F.count_if("on_backbone").alias("on_backbone"), F.avg("depth").alias("avg_depth"), F.sum("downstream_kw").alias("downstream"), F.avg("downstream_kw").alias("avg_downstream"))
