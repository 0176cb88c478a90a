"""Queries of scripted scenarios: overrides, bulk edits, shapes, energy, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import flow, graph, series
from gridloom.plans import adapters as A
from gridloom.plans.registry import query
from gridloom.sources.shared import staged


@query("SELECT c.c_custkey, c.c_name, coalesce(o.kw, c.c_acctbal) AS kw FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS kw FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def load_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings replaced where a change is given."""
    base = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("kw"))
    changes = A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("kw"))
    return series.overridden(base, changes, "c_custkey", ["kw"])


@query("SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '^(red|small)') THEN 'evening' ELSE 'flat' END AS shape FROM part")
def bulk_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property set on all rows whose name matches a pattern."""
    return series.bulk_set(A.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "^(red|small)", "shape", "evening", "flat")


@query("SELECT c_custkey, round(c_acctbal * 0.40, 4) AS kw FROM customer")
def loadmult(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loads by a factor."""
    return series.scaled(A.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("kw")), "kw", 0.40).withColumn("kw", F.round("kw", 4))


@query("SELECT CASE WHEN p_retailprice / 1000 < 0.95 THEN 'low' WHEN p_retailprice / 1000 > 1.05 THEN 'high' ELSE 'normal' END AS band, count(*) AS n FROM part GROUP BY 1")
def voltage_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by band of per-unit values."""
    return A.table(spark, sf_dir, "part").groupBy(series.band(F.col("p_retailprice") / 1000).alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT event_type AS shape, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step, value AS mult FROM events)
SELECT shape, step, round(mult / max(mult) OVER (PARTITION BY shape), 9) AS mult FROM s""")
def normalize_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load shapes scaled to a greatest value of 1."""
    return series.normalized(_shapes(spark, sf_dir), "shape", "mult").select("shape", "step", F.round("mult", 9).alias("mult"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.order import numbered

    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("shape"), "ts", "event_id", F.col("value").alias("mult"))
    return numbered(rows, "ts", "event_id", by=("shape",), name="step").select("shape", "step", "mult")


@query("""
WITH s AS (SELECT event_type AS shape, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step, value AS mult FROM events),
l AS (SELECT s_name AS name, s_acctbal AS kw, CASE s_nationkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS shape FROM supplier)
SELECT l.name, s.step, s.step * 60 AS t_s, round(l.kw * s.mult, 4) AS kw FROM l JOIN s ON s.shape = l.shape WHERE s.step < 24""")
def loadshape_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of 24 steps: each load's rating by its shape's value."""
    steps = series.scenario(24, 60, spark)
    shape = F.when(F.col("s_nationkey") % 3 == 0, "click").when(F.col("s_nationkey") % 3 == 1, "view").otherwise("error")
    loads = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_acctbal", shape.alias("shape"))
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("shape"), "ts", "event_id", F.col("value").alias("mult"))
    run = series.first_steps(rows, "shape", ["ts", "event_id"], 24).join(steps, "step")
    return loads.join(run, "shape").select("name", "step", "t_s", F.round(F.col("s_acctbal") * F.col("mult"), 4).alias("kw"))


_SPANS = "s AS (SELECT event_id, event_type, ts, value, coalesce(lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), ts) AS until FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_spans(A.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", ["event_id"])


@query(f"WITH {_SPANS} SELECT event_id, event_type, round(sum(value * (epoch_us(until) - epoch_us(ts)) / 3.6e9) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id), 4) AS kwh FROM s")
def energy_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each meter since the day began; a reading holds until the next."""
    rows = _spans(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    return series.energy(rows, ["event_type", "day"], ["ts", "event_id"], "value", F.col("hours")).select("event_id", "event_type", F.round("kwh", 4).alias("kwh"))


@query(f"""WITH {_SPANS}, p AS (SELECT event_type, value, ts, until, unnest(generate_series(date_trunc('hour', ts), until, INTERVAL 1 HOUR)) AS start FROM s WHERE until > ts),
h AS (SELECT *, (epoch_us(least(until, start + INTERVAL 1 HOUR)) - epoch_us(greatest(ts, start))) / 3.6e9 AS hours FROM p)
SELECT event_type, CAST(start AS TIMESTAMP) AS start, round(sum(value * hours), 4) AS kwh, round(max(value), 4) AS peak FROM h WHERE hours > 0 GROUP BY event_type, start""")
def demand_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and greatest reading of each meter by the hour, readings split where hours meet."""
    return series.demand(_spans(spark, sf_dir), ["event_type"], "ts", "value", "hour").withColumns({"kwh": F.round("kwh", 4), "peak": F.round("peak", 4)})


@query("SELECT event_type, count(*) AS n, round(max(value), 4) AS worst FROM events WHERE value > 50 GROUP BY 1")
def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings over a threshold, by meter."""
    return series.exceeding(A.table(spark, sf_dir, "events"), "event_type", "value", 50).withColumn("worst", F.round("worst", 4))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, round(avg(value), 6) AS kw, round(max(value), 6) AS peak FROM events WHERE event_type = 'view' GROUP BY 1")
def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One meter's channels by the hour."""
    return series.monitored(A.table(spark, sf_dir, "events"), "event_type", "view", "ts", "hour", {"kw": F.round(F.avg("value"), 6), "peak": F.round(F.max("value"), 6)})


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 0.48 ELSE 4.16 END AS base_kv FROM part")
def voltage_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bus's voltage base by its zone."""
    return A.table(spark, sf_dir, "part").select("p_partkey", series.voltage_base(F.col("p_size") > 40).alias("base_kv"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS bus, c_name FROM customer ORDER BY c_custkey DESC LIMIT 5")
def head_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five of keys that are text, ordered as numbers."""
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bus"), "c_name").orderBy(F.col("bus").cast("long").desc()).limit(5)


@query("SELECT p_partkey, p_size AS kw, p_size % 7 AS kvar, round(p_size / nullif(sqrt(p_size * p_size + (p_size % 7) * (p_size % 7)), 0), 9) AS pf FROM part")
def power_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load's properties with its power factor."""
    kw, kvar = F.col("p_size"), F.col("p_size") % 7
    return A.table(spark, sf_dir, "part").select("p_partkey", kw.alias("kw"), kvar.alias("kvar"), F.round(series.power_factor(kw, kvar), 9).alias("pf"))


_METERS = ("click", "error", "purchase", "signup", "view")


@query(f"""
WITH RECURSIVE {A.CLOSURE_SQL}, last AS (SELECT date_trunc('day', ts) AS tick, event_type AS meter, max_by(value, (ts, event_id)) AS p FROM events GROUP BY 1, 2),
rd AS (SELECT tick, meter, p, p * 0.4 AS q, 50 + list_position({list(_METERS)}, meter) AS node FROM last WHERE tick IN (SELECT tick FROM last GROUP BY tick HAVING count(*) >= 5)),
fl AS (SELECT rd.tick, u.anc, sum(p) AS p, sum(q) AS q FROM rd JOIN up u ON u.node = rd.node GROUP BY 1, 2),
dr AS (SELECT fl.tick, fl.anc, (0.01 * e.length * fl.p + 0.02 * e.length * fl.q) / 2400.0 AS d FROM fl JOIN tree_edges e ON e.k = fl.anc),
v AS (SELECT rd.tick, rd.meter, rd.p, rd.q, 2400.0 - sum(coalesce(dr.d, 0)) AS v FROM rd JOIN up u ON u.node = rd.node LEFT JOIN dr ON dr.tick = rd.tick AND dr.anc = u.anc GROUP BY 1, 2, 3, 4)
SELECT CAST(tick AS TIMESTAMP) AS tick, meter AS load_name, round(v / 2400.0, 9) AS bus_voltage_pu, round(v, 6) AS bus_voltage_v, round(sqrt(p * p + q * q) * 1000 / v, 6) AS current_a FROM v""")
def sweep_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltages at the meters for each complete day tick: load summed up the tree, drops summed down."""
    tree = staged(graph.rooted_by_parent(A.parents(spark, sf_dir)))
    rows = series.barrier(A.readings(spark, sf_dir), "tick", "meter", ["ts", "event_id"], ["p_kw"], len(_METERS))
    at = F.create_map(*[F.lit(x) for i, m in enumerate(_METERS) for x in (m, str(51 + i))])
    rows = rows.select("tick", F.col("meter").alias("load_name"), F.element_at(at, F.col("meter")).alias("node"), "p_kw", (F.col("p_kw") * 0.4).alias("q_kvar"))
    lines = A.tree_edges(spark, sf_dir).select(F.col("dst").alias("node"), (0.01 * F.col("length")).alias("r"), (0.02 * F.col("length")).alias("x"))
    out = flow.telemetry(rows, tree, lines, 2400.0)
    return out.select("tick", "load_name", F.round("bus_voltage_pu", 9).alias("bus_voltage_pu"), F.round("bus_voltage_v", 6).alias("bus_voltage_v"), F.round("current_a", 6).alias("current_a"))
