"""Linear power flow on radial feeders: what lies below summed up, drops summed down, as joins for any number of ticks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import rolled_up, summed_down

#: Per-unit voltages within which a linear drop means anything; a tick that leaves them has no solution.
LEAST_PU, MOST_PU = 0.5, 1.5


def linear_voltages(tree: DataFrame, lines: DataFrame, loads: DataFrame, v0: float) -> DataFrame:
    """node, v from tree (node, parent), lines (node, r, x: of the way to its parent), loads (node, p, q): v0 less, over the
    way from the source, (r P + x Q) / v0 with P and Q all load below."""
    down = rolled_up(tree, loads, "node", {"p": "p_down", "q": "q_down"})
    drop = lines.join(down, "node").select("node", ((F.col("r") * F.col("p_down") + F.col("x") * F.col("q_down")) / v0).alias("drop"))
    return summed_down(tree, drop, "drop", "fall").select("node", (v0 - F.col("fall")).alias("v"))


def tick_voltages(tree: DataFrame, lines: DataFrame, readings: DataFrame, v0: float) -> DataFrame:
    """readings (tick, load_name, node, p_kw, q_kvar) with v, pu, amps and `converged` at their nodes, all ticks in one plan.

    A reading goes to the nodes on its way to the source, where each tick's are summed; the drops there come back over the same ways. `converged` holds for a whole tick.
    """
    ways = readings.join(tree.select("node", "ancestors"), "node").select("tick", "load_name", "node", "p_kw", "q_kvar", F.explode("ancestors").alias("at"))
    flow = ways.groupBy("tick", "at").agg(F.sum("p_kw").alias("p"), F.sum("q_kvar").alias("q"))
    drop = flow.join(lines.withColumnRenamed("node", "at"), "at").select("tick", "at", ((F.col("r") * F.col("p") + F.col("x") * F.col("q")) / v0).alias("drop"))
    fall = ways.join(drop, ["tick", "at"], "left").groupBy("tick", "load_name", "node", "p_kw", "q_kvar").agg(F.sum(F.coalesce("drop", F.lit(0.0))).alias("fall"))
    out = fall.withColumn("v", v0 - F.col("fall")).withColumn("pu", F.col("v") / v0)
    bad = out.filter(~F.col("pu").between(LEAST_PU, MOST_PU)).select("tick").distinct().withColumn("bad", F.lit(True))
    amps = F.sqrt(F.col("p_kw") * F.col("p_kw") + F.col("q_kvar") * F.col("q_kvar")) * 1000 / F.nullif(F.col("v"), F.lit(0.0))
    return out.join(bad, "tick", "left").select("tick", "load_name", "node", "p_kw", "q_kvar", "v", "pu", amps.alias("amps"), F.col("bad").isNull().alias("converged"))


def telemetry(readings: DataFrame, tree: DataFrame, lines: DataFrame, v0: float) -> DataFrame:
    """tick, load_name, p_kw, q_kvar, bus_voltage_pu, bus_voltage_v, current_a of the ticks that have a solution; the others give no rows."""
    made = tick_voltages(tree, lines, readings, v0).filter("converged")
    return made.select("tick", "load_name", "p_kw", "q_kvar", F.col("pu").alias("bus_voltage_pu"), F.col("v").alias("bus_voltage_v"), F.col("amps").alias("current_a"))
