"""Graphs as tables of edges: adjacency, contraction, rooted trees, roll-ups, main path, branches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import is_helper
from gridloom.operators.order import numbered, running
from gridloom.sources.shared import Rounds, staged


def adjacency(edges: DataFrame) -> DataFrame:
    """node, nbr of undirected edges (src, dst), each pair once in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).union(edges.select("dst", "src")).distinct()


def two_hops(near: DataFrame) -> DataFrame:
    """node, nbr, beyond: each helper's neighbours with theirs, for a look at what contraction does."""
    helpers = near.filter(is_helper(F.col("node")))
    return helpers.join(near.select(F.col("node").alias("nbr"), F.col("nbr").alias("beyond")), "nbr").select("node", "nbr", "beyond")


def helpers_among(nodes: DataFrame) -> DataFrame:
    """The helpers among nodes, such as a main path, that should have none."""
    return nodes.filter(is_helper(F.col("node")))


def contracted(near: DataFrame) -> DataFrame:
    """Adjacency without helper nodes; a helper that ends in r and has two neighbours joins them, other helpers vanish with their edges."""
    ends = near.filter(is_helper(F.col("node")) & F.col("node").endswith("r")).groupBy("node").agg(F.min("nbr").alias("a"), F.max("nbr").alias("b"), F.count("*").alias("n")).filter("n = 2")
    joined = ends.select(F.col("a").alias("node"), F.col("b").alias("nbr")).union(ends.select("b", "a"))
    real = near.filter(~is_helper(F.col("node")) & ~is_helper(F.col("nbr")))
    return real.union(joined).distinct()


def _ranked(pairs: DataFrame, by: str, of: str) -> DataFrame:
    """pairs with `token`: text that orders what belongs to one `by` as `of` does, and of which none begins another. A hub's neighbours need not meet in one task."""
    k = F.col("_k").cast("string")
    return numbered(pairs, by, of, name="_k").withColumn("token", F.concat(F.lpad(F.length(k).cast("string"), 2, "0"), k)).drop("_k")


def rooted(near: DataFrame, source: str, most_levels: int = 10_000) -> DataFrame:
    """node, parent, depth, path of all nodes that can be reached from source, breadth first, in any graph.

    `path` orders the nodes of a level as a queue would pop them, neighbours sorted as strings. A node met from several parents belongs to the first. A level is a join of the last one with the edges, written to
    the shared folder. near holds both directions, so neighbours lie at most a level apart: leaving out the last two levels leaves out all that was seen, and cycles end.
    For deep trees see `rooted_tree`. Raises ValueError where most_levels rounds don't reach the end.
    """
    spark = near.sparkSession
    ranked = Rounds(_ranked(near, "node", "nbr"))
    level = Rounds(spark.createDataFrame([(source, None, 0, "")], "node string, parent string, depth int, path string"))
    kept, seen = [level], level.df.select("node")
    for _ in range(most_levels):
        step = level.df.select(F.col("node").alias("parent"), "depth", "path").join(ranked.df, F.col("parent") == F.col("node"))
        step = step.select(F.col("nbr").alias("node"), "parent", (F.col("depth") + 1).alias("depth"), F.concat("path", "token").alias("path"))
        best = step.groupBy("node").agg(F.min_by(F.struct("parent", "depth", "path"), "path").alias("b")).select("node", "b.*")
        last, level = level, Rounds(best.join(seen, "node", "left_anti"))
        if level.df.isEmpty():
            levels = staged(reduce(DataFrame.unionByName, [x.df for x in kept]))
            for x in (ranked, level, *kept):
                x.done()
            return levels
        seen = last.df.select("node").union(level.df.select("node"))
        kept.append(level)
    raise ValueError(f"more than {most_levels} levels")


def _list_places(arcs: DataFrame) -> DataFrame:
    """id, left: how many arcs follow each of arcs (id, succ) until the one without a successor; those that never get there are left out. Ways double in length each round."""
    n, state = arcs.count(), Rounds(arcs.select("id", "succ", F.col("succ").isNotNull().cast("long").alias("left")))
    for _ in range(max(1, n).bit_length() + 1):
        if state.df.filter("succ IS NOT NULL").isEmpty():
            break
        far = state.df.select(F.col("id").alias("n"), F.col("succ").alias("far"), F.col("left").alias("more"))
        joined = state.df.join(far, F.col("succ") == F.col("n"), "left")
        state.step(joined.select("id", F.col("far").alias("succ"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    return state.df.filter("succ IS NULL").select("id", "left")


def rooted_tree(near: DataFrame, source: str) -> DataFrame:
    """node, parent, depth, path of all nodes that can be reached from source, as `rooted` gives them, of a graph without cycles there, in about log2(nodes) rounds however deep it is.

    Edges in both directions form a tour around the tree: after an edge into a node comes the edge out of it to its next neighbour. The places of edges in that list, found by doubling ways, tell parents from
    children: into a child comes before out of it. Running sums over the list of one down and one up are depths. In a second tour children follow each other as their names do, and `path`
    is the place in that: of one depth, it orders nodes as a queue does. Raises ValueError where the part that holds source has a cycle.
    """
    spark = near.sparkSession
    arcs = numbered(near.select("node", "nbr"), "node", "nbr", name="id")
    ends = arcs.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    twins = arcs.select(F.col("node").alias("nbr"), F.col("nbr").alias("node"), F.col("id").alias("twin"))
    of_nbr = ends.withColumnRenamed("node", "nbr")
    tour = Rounds(arcs.join(twins, ["node", "nbr"]).join(of_nbr, "nbr").select("id", "node", "nbr", "twin", "first", "last"))
    # the tour begins with the source's first edge, and ends before it would begin anew
    around = F.when(F.col("twin") == F.col("last"), F.when(F.col("nbr") != source, F.col("first"))).otherwise(F.col("twin") + 1)
    left = _list_places(tour.df.select("id", around.alias("succ")))
    placed = Rounds(tour.df.join(left, "id"))
    tour.done()
    back = placed.df.select(F.col("id").alias("twin"), F.col("left").alias("back"))
    both = placed.df.join(back, "twin")
    down = F.col("left") > F.col("back")
    n_arcs, reached = placed.df.count(), placed.df.select("node").distinct()
    if n_arcs and (both.count() != n_arcs or arcs.join(reached, "node", "left_semi").count() != n_arcs or n_arcs != 2 * (reached.count() - 1)):
        raise ValueError(f"there is a cycle in the part that holds {source}")
    sides = Rounds(both.select("id", "node", "nbr", "twin", down.alias("down"), F.when(down, 1).otherwise(-1).alias("step"), (n_arcs - F.col("left")).alias("at")))
    placed.done()
    depths = running(sides.df, "step", "at", name="depth").filter("down").select(F.col("nbr").alias("node"), F.col("node").alias("parent"), F.col("depth").cast("int").alias("depth"), "id", "twin")
    depths = Rounds(depths)
    # children in the order of their names: from a node's edge to its parent, to the first child, from each child to the next, and back
    ranked = numbered(depths.df, "parent", "node", name="k")
    span = ranked.groupBy("parent").agg(F.min("k").alias("least"), F.max("k").alias("most"))
    ranked = ranked.join(span, "parent").join(span.select(F.col("parent").alias("node"), F.col("least").alias("child")), "node", "left")
    # the edge down to the k-th is 2 k, that up from it 2 k + 1
    own = ranked.select("node", "k", "least", "most", "child", "parent")
    above = own.select(F.col("node").alias("parent"), F.col("k").alias("up"))
    own = own.join(above, "parent", "left")
    into = own.select((2 * F.col("k")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("k") + 1).alias("succ"))
    out = own.select((2 * F.col("k") + 1).alias("id"), F.when(F.col("k") < F.col("most"), 2 * F.col("k") + 2).otherwise(2 * F.col("up") + 1).alias("succ"))
    order = _list_places(into.union(out)).filter("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("k"), (n_arcs - F.col("left")).alias("at"))
    rows = ranked.join(order, "k").select("node", "parent", "depth", F.lpad(F.col("at").cast("string"), 20, "0").alias("path"))
    top = spark.createDataFrame([(source, None, 0, "")], rows.schema)
    made = staged(rows.union(top))
    sides.done()
    depths.done()
    return made


def rooted_by_parent(parents: DataFrame, most_rounds: int = 40, ancestors: bool = True) -> DataFrame:
    """The same from node, parent where a root's parent is null; nodes that no root leads to are left out. `ancestors` runs from the root to the node itself, and can be spared.

    Ways double in length each round, so a tree of depth d takes about log2(d) joins. Raises ValueError on a cycle.
    """
    ranked = _ranked(parents, "parent", "node").withColumn("token", F.when(F.col("parent").isNull(), "").otherwise(F.col("token")))
    own = {"ancestors": F.array("node")} if ancestors else {}
    state = Rounds(ranked.select("node", "parent", F.col("parent").alias("up"), F.col("parent").alias("above"), F.col("token").alias("path"), F.lit(0).alias("depth"), *[c.alias(k) for k, c in own.items()]).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1)))
    for _ in range(most_rounds):
        if state.df.filter("up IS NOT NULL").isEmpty():
            return state.df.filter("above IS NULL").select("node", "parent", "depth", "path", *own)
        more = state.df.select(F.col("node").alias("n"), F.col("up").alias("far"), F.col("above").alias("over"), F.col("path").alias("begin"), F.col("depth").alias("higher"), *[F.col(k).alias("first") for k in own])
        met = F.col("n").isNotNull()
        joined = state.df.join(more, F.col("up") == F.col("n"), "left")
        state.step(
            joined.select(
                "node",
                "parent",
                F.col("far").alias("up"),
                F.when(met, F.col("over")).otherwise(F.col("above")).alias("above"),
                F.when(met, F.concat("begin", "path")).otherwise(F.col("path")).alias("path"),
                (F.col("depth") + F.coalesce("higher", F.lit(0))).alias("depth"),
                *[F.when(met, F.concat("first", k)).otherwise(F.col(k)).alias(k) for k in own],
            )
        )
    raise ValueError("parents form a cycle")


def subtree_sums(tree: DataFrame, values: DataFrame, node: str, value: str, name: str = "downstream") -> DataFrame:
    """node, sum of value over the node and all below it."""
    known = values.join(tree.select(F.col("node").alias(node)), node, "left_semi")
    return rolled_up(tree, known, node, {value: name})


def rolled_up(parents: DataFrame, values: DataFrame, node: str, names: dict[str, str], most_rounds: int = 40) -> DataFrame:
    """node, and for each value column the sum of it (named as told) over the node and all below it, from node, parent.

    A round adds what hangs as far below again as the sums reach, then ways double: log2(depth) joins of a row for each node, however deep the tree is. Raises ValueError on a cycle.
    """
    own = values.groupBy(F.col(node).alias("node")).agg(*[F.sum(c).alias(c) for c in names])
    state = Rounds(parents.select("node", F.col("parent").alias("up")).join(own, "node", "left").select("node", "up", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]))
    for _ in range(most_rounds):
        below = state.df.filter("up IS NOT NULL")
        if below.isEmpty():
            return state.df.select("node", *[F.col(c).alias(name) for c, name in names.items()])
        more = below.groupBy(F.col("up").alias("n")).agg(*[F.sum(c).alias(f"more_{c}") for c in names])
        far = state.df.select(F.col("node").alias("m"), F.col("up").alias("far"))
        joined = state.df.join(more, F.col("node") == F.col("n"), "left").join(far, F.col("up") == F.col("m"), "left")
        state.step(joined.select("node", F.col("far").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))).alias(c) for c in names]))
    raise ValueError("parents form a cycle")


def carried_down(parents: DataFrame, values: DataFrame, value: str, merge: Callable[[Column, Column], Column], none: Column, name: str, most_rounds: int = 40) -> DataFrame:
    """node, what the values (node, value) on the way from the root to it, its own included, merge to: merge(above, own) in any grouping. A node without a value has `none`.

    Ways double in length each round: log2(depth) joins of a row for each node. Raises ValueError on a cycle.
    """
    state = Rounds(parents.select("node", F.col("parent").alias("up")).join(values.select("node", F.col(value).alias("s")), "node", "left").select("node", "up", F.coalesce("s", none).alias("s")))
    for _ in range(most_rounds):
        if state.df.filter("up IS NOT NULL").isEmpty():
            return state.df.select("node", F.col("s").alias(name))
        far = state.df.select(F.col("node").alias("m"), F.col("up").alias("far"), F.col("s").alias("above"))
        joined = state.df.join(far, F.col("up") == F.col("m"), "left")
        state.step(joined.select("node", F.col("far").alias("up"), F.when(F.col("m").isNull(), F.col("s")).otherwise(merge(F.col("above"), F.col("s"))).alias("s")))
    raise ValueError("parents form a cycle")


def summed_down(parents: DataFrame, values: DataFrame, value: str, name: str = "distance", most_rounds: int = 40) -> DataFrame:
    """node, sum of value (node, value) over the way from the root, the node's own included, from node, parent."""
    return carried_down(parents, values, value, lambda above, own: above + own, F.lit(0.0), name, most_rounds)


def main_path(tree: DataFrame, sums: DataFrame, total: str = "downstream") -> DataFrame:
    """The nodes on the way from the root to a leaf that follows the child with the greatest total; ties go to the least name: all steps that lead to them are the best."""
    best = tree.filter("parent IS NOT NULL").join(sums, "node").groupBy("parent").agg(F.min_by("node", F.struct(-F.col(total), F.col("node"))).alias("node"))
    follows = best.select("node", F.lit(True).alias("best")).union(tree.filter("parent IS NULL").select("node", F.lit(True)))
    kept = carried_down(tree, follows, "best", lambda above, own: above & own, F.lit(False), "kept").filter("kept")
    return tree.join(kept, "node").select("node", "depth")


def branches(tree: DataFrame) -> DataFrame:
    """node, branch: an only child keeps its parent's branch; where the way splits, children get new ones in the order of the queue. A node's is the last that was given above it."""
    split = tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).filter("n > 1").select("parent")
    heads = numbered(tree.join(split, "parent", "left_semi").select("node", "depth", "path"), "depth", "path", name="k").select("node", (F.col("k") + 1).alias("k"))
    found = carried_down(tree, heads, "k", lambda above, own: F.coalesce(own, above), F.lit(None).cast("long"), "branch")
    return found.select("node", F.coalesce("branch", F.lit(0)).alias("branch"))


def path_sums(tree: DataFrame, values: DataFrame, value: str, name: str = "distance") -> DataFrame:
    """node, sum of value (node, value) over the way from the root, the node's own included."""
    return summed_down(tree, values, value, name)
