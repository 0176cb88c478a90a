"""Queries over trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import flow, graph
from gridloom.operators.placement import NO_BRANCH, NO_DEPTH
from gridloom.plans import adapters as A
from gridloom.plans.registry import query
from gridloom.sources.shared import staged


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(graph.rooted_by_parent(A.parents(spark, sf_dir), ancestors=False))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.loads(spark, sf_dir).select(F.col("bus").cast("string").alias("bus"), "base_kw")


_HELPERS = """named AS (SELECT CAST(p AS VARCHAR) || CASE WHEN p % 7 = 3 THEN 'r' WHEN p % 11 = 5 THEN 's' WHEN p % 13 = 6 THEN '_OPEN' ELSE '' END AS a,
  CAST(k AS VARCHAR) || CASE WHEN k % 7 = 3 THEN 'r' WHEN k % 11 = 5 THEN 's' WHEN k % 13 = 6 THEN '_OPEN' ELSE '' END AS b FROM tree_edges),
near AS (SELECT DISTINCT a AS node, b AS nbr FROM named UNION SELECT b, a FROM named)"""
_IS_HELPER = "(x LIKE '%r' OR x LIKE '%s' OR contains(x, '_OPEN'))"


@query(f"WITH {A.TREE_SQL}, {_HELPERS} SELECT node, count(*) AS degree, string_agg(nbr, ',' ORDER BY nbr) AS nbrs FROM near GROUP BY node")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's neighbours, sorted."""
    near = graph.adjacency(A.helper_edges(spark, sf_dir))
    return near.groupBy("node").agg(F.count("*").alias("degree"), F.array_join(F.sort_array(F.collect_list("nbr")), ",").alias("nbrs"))  # a tree's degrees are few


@query(f"""
WITH {A.TREE_SQL}, {_HELPERS},
ends AS (SELECT min(nbr) AS a, max(nbr) AS b FROM near WHERE node LIKE '%r' GROUP BY node HAVING count(*) = 2)
SELECT node, nbr FROM near WHERE NOT {_IS_HELPER.replace('x', 'node')} AND NOT {_IS_HELPER.replace('x', 'nbr')}
UNION SELECT a, b FROM ends UNION SELECT b, a FROM ends""")
def contract_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without its helper nodes."""
    return graph.contracted(graph.adjacency(A.helper_edges(spark, sf_dir)))


@query(f"WITH {A.TREE_SQL}, {_HELPERS} SELECT node, count(*) AS n FROM near WHERE {_IS_HELPER.replace('x', 'node')} GROUP BY node")
def helper_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helper nodes with their number of neighbours."""
    return graph.adjacency(A.helper_edges(spark, sf_dir)).filter(graph.is_helper(F.col("node"))).groupBy("node").agg(F.count("*").alias("n"))


@query(f"WITH {A.TREE_SQL}, {_HELPERS} SELECT a.node, a.nbr, b.nbr AS beyond FROM near a JOIN near b ON b.node = a.nbr WHERE {_IS_HELPER.replace('x', 'a.node')}")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helper nodes with their neighbours' neighbours."""
    return graph.two_hops(graph.adjacency(A.helper_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {A.CLOSURE_SQL} SELECT CAST(node AS VARCHAR) AS node, CAST(max(steps) AS INT) AS depth FROM up GROUP BY node")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the source, breadth first over undirected edges."""
    return graph.rooted_tree(graph.adjacency(A.tree_edges(spark, sf_dir)), "0").select("node", "depth")


@query(f"""
WITH RECURSIVE {A.CLOSURE_SQL}, {A.LOADS_SQL}, reached AS (SELECT node, CAST(max(steps) AS INT) AS depth FROM up GROUP BY node HAVING bool_or(anc = 1) OR node = 0)
SELECT l.name, coalesce(r.depth, 999) AS depth, CASE WHEN r.node IS NULL THEN -1 ELSE 0 END AS branch FROM loads l LEFT JOIN reached r ON r.node = l.bus""")
def unreachable_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads on buses that can't be reached (all but part 0 and what hangs below part 1) have defaults."""
    tree = _tree(spark, sf_dir)
    below = graph.carried_down(tree, tree.filter("node = '1'").select("node", F.lit(True).alias("v")), "v", lambda above, own: above | own, F.lit(False), "below")
    tree = tree.join(below, "node").filter("below OR node = '0'")
    rows = A.loads(spark, sf_dir).join(tree, F.col("bus").cast("string") == F.col("node"), "left")
    return rows.select("name", F.coalesce("depth", F.lit(NO_DEPTH)).alias("depth"), F.when(F.col("node").isNull(), NO_BRANCH).otherwise(0).alias("branch"))


#: Order of the queue: by depth, then by the sibling ranks on the way from the source, children sorted as strings.
_BRANCH_SQL = f"""RECURSIVE {A.TREE_SQL},
ranked AS (SELECT p, k, lpad(CAST(row_number() OVER (PARTITION BY p ORDER BY CAST(k AS VARCHAR)) AS VARCHAR), 8, '0') AS r, count(*) OVER (PARTITION BY p) AS n FROM tree_edges),
walk(node, depth, path, n) AS (SELECT 0, 0, '', 1 UNION ALL SELECT e.k, w.depth + 1, w.path || e.r, e.n FROM walk w JOIN ranked e ON e.p = w.node),
heads AS (SELECT node, row_number() OVER (ORDER BY depth, path) AS k FROM walk WHERE n > 1),
down(node, branch) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT e.k, coalesce(h.k, d.branch) FROM down d JOIN ranked e ON e.p = d.node LEFT JOIN heads h ON h.node = e.k)"""


@query(f"WITH {_BRANCH_SQL} SELECT CAST(node AS VARCHAR) AS node, branch FROM down")
def branch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches numbered where the tree splits."""
    return graph.branches(graph.rooted_tree(graph.adjacency(A.tree_edges(spark, sf_dir)), "0"))


_SUMS_SQL = f"{A.CLOSURE_SQL}, {A.LOADS_SQL}, own AS (SELECT bus, sum(base_kw) AS kw FROM loads GROUP BY bus), sums AS (SELECT anc AS node, coalesce(sum(kw), 0) AS downstream FROM up LEFT JOIN own ON own.bus = up.node GROUP BY anc)"


@query(f"WITH RECURSIVE {_SUMS_SQL} SELECT CAST(node AS VARCHAR) AS node, round(downstream, 4) AS downstream FROM sums")
def subtree_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load at and below every node."""
    out = graph.rolled_up(A.parents(spark, sf_dir), _values(spark, sf_dir), "bus", {"base_kw": "downstream"})
    return out.select("node", F.round("downstream", 4).alias("downstream"))


_PATH_SQL = f"""{_SUMS_SQL},
best AS (SELECT p, arg_min(k, (-round(downstream, 4), CAST(k AS VARCHAR))) AS k FROM tree_edges JOIN sums ON sums.node = tree_edges.k GROUP BY p),
spine(node, depth) AS (SELECT 0, 0 UNION ALL SELECT b.k, s.depth + 1 FROM spine s JOIN best b ON b.p = s.node)"""


@query(f"WITH RECURSIVE {_PATH_SQL} SELECT CAST(node AS VARCHAR) AS node, CAST(depth AS INT) AS depth FROM spine")
def main_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way that follows the greatest load."""
    tree = _tree(spark, sf_dir)
    sums = graph.subtree_sums(tree, _values(spark, sf_dir), "bus", "base_kw").withColumn("downstream", F.round("downstream", 4))
    return graph.main_path(tree, staged(sums))


@query(f"""
WITH RECURSIVE {_PATH_SQL}, named AS (SELECT CAST(node AS VARCHAR) || CASE WHEN node % 7 = 3 THEN 'r' WHEN node % 11 = 5 THEN 's' WHEN node % 13 = 6 THEN '_OPEN' ELSE '' END AS node, CAST(depth AS INT) AS depth FROM spine)
SELECT node, depth FROM named WHERE {_IS_HELPER.replace('x', 'node')}""")
def helpers_on_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helper nodes on the main path, of a tree whose helpers were not contracted."""
    path = main_path(spark, sf_dir)
    return graph.helpers_among(path.withColumn("node", A.helper_name("node")))


@query(f"WITH RECURSIVE {_SUMS_SQL} SELECT CAST(node AS VARCHAR) AS node, round(downstream, 4) AS downstream FROM sums ORDER BY round(downstream, 4) DESC, CAST(node AS VARCHAR) LIMIT 20")
def top_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nodes with the most load below."""
    return subtree_sum(spark, sf_dir).orderBy(F.desc("downstream"), "node").limit(20)


@query(f"WITH RECURSIVE {A.CLOSURE_SQL} SELECT CAST(u.node AS VARCHAR) AS node, round(coalesce(sum(e.length), 0), 4) AS distance FROM up u LEFT JOIN tree_edges e ON e.k = u.anc GROUP BY u.node")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the way from the source."""
    lengths = A.tree_edges(spark, sf_dir).select(F.col("dst").alias("node"), "length")
    return graph.summed_down(A.parents(spark, sf_dir), lengths, "length").select("node", F.round("distance", 4).alias("distance"))


@query(f"""
WITH RECURSIVE {_SUMS_SQL},
d AS (SELECT k AS node, (0.0001 * length * downstream / 1000 + 0.0002 * length * downstream * 0.5 / 1000) / 2400.0 AS d FROM tree_edges JOIN sums ON sums.node = tree_edges.k)
SELECT CAST(u.node AS VARCHAR) AS node, round(2400.0 - coalesce(sum(d.d), 0), 6) AS v FROM up u LEFT JOIN d ON d.node = u.anc GROUP BY u.node""")
def lindist_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltages by linear drops along the tree."""
    return _voltages(spark, sf_dir).select("node", F.round("v", 6).alias("v"))


def _voltages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.tree_edges(spark, sf_dir).select(F.col("dst").alias("node"), (0.0001 * F.col("length")).alias("r"), (0.0002 * F.col("length")).alias("x"))
    loads = _values(spark, sf_dir).select(F.col("bus").alias("node"), (F.col("base_kw") / 1000).alias("p"), (F.col("base_kw") * 0.5 / 1000).alias("q"))
    return flow.linear_voltages(A.parents(spark, sf_dir), lines, loads, 2400.0)


@query(f"""
WITH RECURSIVE {_SUMS_SQL},
d AS (SELECT k AS node, length, (0.0001 * length * downstream / 1000 + 0.0002 * length * downstream * 0.5 / 1000) / 2400.0 AS d FROM tree_edges JOIN sums ON sums.node = tree_edges.k)
SELECT CAST(u.node AS VARCHAR) AS node, round(coalesce(sum(d.length), 0), 4) AS distance, round((2400.0 - coalesce(sum(d.d), 0)) / 2400.0, 9) AS pu FROM up u LEFT JOIN d ON d.node = u.anc GROUP BY u.node""")
def voltage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-unit voltage against the distance from the source, for every node."""
    v = _voltages(spark, sf_dir).select("node", F.round(F.col("v") / 2400.0, 9).alias("pu"))
    return path_length(spark, sf_dir).join(v, "node").select("node", "distance", "pu")
