"""Queries of the placement of representative meters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import graph, placement
from gridloom.plans import adapters as A
from gridloom.plans.graphs import _BRANCH_SQL, _HELPERS, _IS_HELPER, _PATH_SQL
from gridloom.plans.registry import query
from gridloom.plans.texts import made_once
from gridloom.sources.shared import staged

TARGET = 49


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loads with size class, depth, branch, downstream load, backbone and score, scores rounded so that equal ones tie; made once in a session."""

    def make(folder: str) -> None:
        tree = staged(graph.rooted_by_parent(A.parents(spark, sf_dir), ancestors=False))
        loads = A.loads(spark, sf_dir)
        values = loads.select(F.col("bus").cast("string").alias("bus"), "base_kw")
        sums = staged(graph.rolled_up(tree, values, "bus", {"base_kw": "downstream"}).withColumn("downstream", F.round("downstream", 4)))
        out = placement.attached(placement.size_classed(loads), tree, sums, graph.main_path(tree, sums), graph.branches(tree))
        placement.scored(out).withColumn("score", F.round("score", 6)).write.parquet(f"{folder}/scored")

    return spark.read.parquet(f"{made_once(spark, 'placement', sf_dir, make)}/scored")


_REST_SQL = _PATH_SQL.split("p_partkey >= 1),", 1)[1]
_SCORED_SQL = f"""WITH {_BRANCH_SQL}, {_REST_SQL},
q AS (SELECT quantile_cont(base_kw, [0.25, 0.5, 0.75]) AS q FROM loads),
depths AS (SELECT node, CAST(max(steps) AS INT) AS depth FROM up GROUP BY node),
most AS (SELECT max(round(downstream, 4)) AS d FROM sums),
base AS (SELECT l.*, CASE WHEN base_kw <= q[1] THEN 'Small' WHEN base_kw <= q[2] THEN 'Medium' WHEN base_kw <= q[3] THEN 'Large' ELSE 'Very Large' END AS size_class,
  coalesce(round(s.downstream, 4), 0) AS downstream_kw, coalesce(round(s.downstream, 4), 0) / most.d AS downstream_score, coalesce(t.depth, 999) AS depth, CAST(coalesce(b.branch, -1) AS BIGINT) AS branch, p.node IS NOT NULL AS on_backbone
  FROM loads l CROSS JOIN q CROSS JOIN most LEFT JOIN sums s ON s.node = l.bus LEFT JOIN depths t ON t.node = l.bus LEFT JOIN down b ON b.node = l.bus LEFT JOIN spine p ON p.node = l.bus),
scored AS (SELECT *, round(0.30 * least(base_kw / 100.0, 1.0) + 0.20 * depth / (SELECT max(depth) FROM base) + 0.40 * downstream_score + 0.20 * CASE WHEN on_backbone THEN 1.5 ELSE 0.0 END, 6) AS score FROM base)"""


def _class_step(k: int) -> str:
    """SQL for the k-th size class: the loads that its rounds pick, given those of the classes before."""
    used = " UNION ALL ".join(f"SELECT bus FROM pick{j}" for j in range(k)) or "SELECT NULL WHERE false"
    return f"""own{k} AS (SELECT s.*, t.turn, c.quota FROM scored s JOIN classes c ON c.size_class = s.size_class AND c.k = {k} JOIN turns t ON t.size_class = s.size_class AND t.branch = s.branch WHERE s.bus NOT IN ({used})),
best{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bus ORDER BY score DESC, load_seq) AS b FROM own{k}) WHERE b = 1),
pick{k} AS (SELECT * FROM (SELECT *, {k} AS k, row_number() OVER (ORDER BY round_no, turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, load_seq) AS round_no FROM best{k})) WHERE place <= quota)"""


_ROBIN_SQL = f"""{_SCORED_SQL},
classes AS (SELECT size_class, row_number() OVER (ORDER BY min(load_seq)) - 1 AS k, greatest(1, round_even({TARGET} * count(*) / (SELECT count(*) FROM scored), 0)) AS quota FROM scored GROUP BY size_class),
turns AS (SELECT size_class, branch, min(load_seq) AS turn FROM scored GROUP BY 1, 2),
{', '.join(_class_step(k) for k in range(4))},
chosen AS (SELECT *, row_number() OVER (ORDER BY k, place) AS pick FROM ({' UNION ALL BY NAME '.join(f'SELECT * FROM pick{k}' for k in range(4))})),
meters AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM chosen) > {TARGET} THEN -score ELSE 0 END, pick) AS m FROM chosen QUALIFY m <= {TARGET})"""


@query(f"WITH {A.LOADS_SQL}, q AS (SELECT quantile_cont(base_kw, [0.25, 0.5, 0.75]) AS q FROM loads) SELECT CASE WHEN base_kw <= q[1] THEN 'Small' WHEN base_kw <= q[2] THEN 'Medium' WHEN base_kw <= q[3] THEN 'Large' ELSE 'Very Large' END AS size_class, count(*) AS n, round(max(base_kw), 4) AS most FROM loads CROSS JOIN q GROUP BY 1")
def quartile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by quartile."""
    return placement.size_classed(A.loads(spark, sf_dir)).groupBy("size_class").agg(F.count("*").alias("n"), F.round(F.max("base_kw"), 4).alias("most"))


@query(f"{_SCORED_SQL} SELECT name, size_class, CAST(branch AS BIGINT) AS branch, depth, downstream_kw, on_backbone, score FROM scored")
def placement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every load's score."""
    return _scored(spark, sf_dir).select("name", "size_class", "branch", "depth", "downstream_kw", "on_backbone", "score")


@query(f"{_ROBIN_SQL} SELECT name, size_class, branch, score, m - 1 AS pick FROM meters")
def round_robin_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loads that the rounds over branches pick, in order."""
    return placement.round_robin(_scored(spark, sf_dir), TARGET).select("name", "size_class", "branch", "score", "pick")


@query(f"{_ROBIN_SQL} SELECT printf('M%03d', m) AS meter_id, name AS load_name, bus, base_kw, branch, depth, downstream_kw, size_class, on_backbone FROM meters")
def meter_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picked loads as numbered meters."""
    return placement.meters(placement.round_robin(_scored(spark, sf_dir), TARGET))


@query(f"{_SCORED_SQL} SELECT name, score FROM scored ORDER BY score DESC, load_seq LIMIT {TARGET}")
def truncate_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best loads by score."""
    rows = _scored(spark, sf_dir).withColumn("pick", F.col("load_seq"))
    return placement.truncated(rows, TARGET).select("name", "score")


@query(f"{_SCORED_SQL} SELECT branch, count(*) AS n FROM scored GROUP BY branch")
def branch_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by branch."""
    return _scored(spark, sf_dir).groupBy("branch").agg(F.count("*").alias("n"))


@query(f"{_ROBIN_SQL} SELECT (SELECT count(DISTINCT bus) FROM meters WHERE on_backbone) AS covered, (SELECT count(DISTINCT bus) FROM scored WHERE on_backbone) AS eligible")
def backbone_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbone buses that have a meter, and those that have a load."""
    rows = _scored(spark, sf_dir)
    picked = placement.round_robin(rows, TARGET)
    return picked.filter("on_backbone").agg(F.countDistinct("bus").alias("covered")).crossJoin(rows.filter("on_backbone").agg(F.countDistinct("bus").alias("eligible")))  # one row each


@query(f"{_ROBIN_SQL} SELECT count(*) AS n, count(DISTINCT branch) AS branches, count(*) FILTER (on_backbone) AS on_backbone, round(avg(depth), 6) AS avg_depth, round(sum(downstream_kw), 3) AS downstream, round(avg(downstream_kw), 3) AS avg_downstream FROM meters")
def placement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of the picked loads."""
    out = placement.summary(placement.round_robin(_scored(spark, sf_dir), TARGET))
    return out.withColumns({"avg_depth": F.round("avg_depth", 6), "downstream": F.round("downstream", 3), "avg_downstream": F.round("avg_downstream", 3)})


@query(f"{_ROBIN_SQL} SELECT size_class, count(*) AS n FROM meters GROUP BY 1")
def size_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picked loads by size class."""
    return placement.round_robin(_scored(spark, sf_dir), TARGET).groupBy("size_class").agg(F.count("*").alias("n"))


#: The contracted tree by the walk from its source, and what `scored` is made of, over nodes that are numbers again.
_STRATEGY_SQL = f"""WITH RECURSIVE {A.TREE_SQL}, {_HELPERS}, {A.LOADS_SQL},
ends AS (SELECT min(nbr) AS a, max(nbr) AS b FROM near WHERE node LIKE '%r' GROUP BY node HAVING count(*) = 2),
bare AS (SELECT node, nbr FROM near WHERE NOT {_IS_HELPER.replace('x', 'node')} AND NOT {_IS_HELPER.replace('x', 'nbr')} UNION SELECT a, b FROM ends UNION SELECT b, a FROM ends),
fan AS (SELECT node, nbr, lpad(CAST(row_number() OVER (PARTITION BY node ORDER BY nbr) AS VARCHAR), 8, '0') AS r FROM bare),
walk(node, parent, depth, path) AS (SELECT '0', CAST(NULL AS VARCHAR), 0, '' UNION ALL SELECT f.nbr, w.node, w.depth + 1, w.path || f.r FROM walk w JOIN fan f ON f.node = w.node WHERE f.nbr IS DISTINCT FROM w.parent),
kids AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n FROM walk),
heads AS (SELECT node, row_number() OVER (ORDER BY depth, path) AS k FROM kids WHERE n > 1 AND parent IS NOT NULL),
below(node, branch) AS (SELECT '0', CAST(0 AS BIGINT) UNION ALL SELECT c.node, coalesce(h.k, b.branch) FROM below b JOIN walk c ON c.parent = b.node LEFT JOIN heads h ON h.node = c.node),
climb(node, anc) AS (SELECT node, node FROM walk UNION ALL SELECT c.node, w.parent FROM climb c JOIN walk w ON w.node = c.anc WHERE w.parent IS NOT NULL),
own AS (SELECT CAST(bus AS VARCHAR) AS bus, sum(base_kw) AS kw FROM loads GROUP BY bus),
total AS (SELECT anc AS node, coalesce(sum(kw), 0) AS downstream FROM climb LEFT JOIN own ON own.bus = climb.node GROUP BY anc),
best AS (SELECT w.parent, arg_min(w.node, (-round(t.downstream, 4), w.node)) AS node FROM walk w JOIN total t ON t.node = w.node WHERE w.parent IS NOT NULL GROUP BY w.parent),
way(node) AS (SELECT '0' UNION ALL SELECT b.node FROM way JOIN best b ON b.parent = way.node),
sums AS (SELECT TRY_CAST(node AS BIGINT) AS node, downstream FROM total), up AS (SELECT TRY_CAST(node AS BIGINT) AS node, depth AS steps FROM walk), down AS (SELECT TRY_CAST(node AS BIGINT) AS node, branch FROM below), spine AS (SELECT TRY_CAST(node AS BIGINT) AS node FROM way),
q AS {_ROBIN_SQL.split("q AS ", 1)[1]}"""


@query(f"{_STRATEGY_SQL} SELECT printf('M%03d', m) AS meter_id, name AS load_name, bus, base_kw, branch, depth, downstream_kw, size_class, on_backbone FROM meters")
def hybrid_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole strategy at once: helpers contracted, what is left rooted from undirected edges, loads rolled up, scored and chosen."""
    chosen = placement.HybridPlacement(TARGET, (4, 6)).select(A.loads(spark, sf_dir), A.helper_edges(spark, sf_dir), "0")
    return placement.meters(chosen)
