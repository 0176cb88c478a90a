"""Queries over a script that compiles others, edits what they define and runs in between; its text is made from the driver's tables.

The master clears what stood before, and compiles a file in another folder, which redirects to regulators (suppliers, each like the one before) and loads (customers). From the folder that this leaves behind
it redirects to bulk edits (a rule for each part) and to steps (regions), each of which edits loads and then runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import adapters as A
from gridloom.plans.registry import query
from gridloom.plans.texts import as_text, made_once, one_file
from gridloom.sources import statements as S

_REGULATOR = """'New RegControl.R' || s_suppkey || CASE WHEN s_suppkey % 9 = 0 THEN ' transformer=T' || s_suppkey || ' winding=' || (1 + s_suppkey % 2) ELSE ' like=r' || (s_suppkey - 1) || CASE WHEN s_suppkey % 4 = 2 THEN ' winding=' || (3 + s_suppkey % 5) ELSE '' END END"""
_LOAD = "'New Load.S' || c_custkey || ' Bus1=' || (c_custkey % 50) || '.1 Phases=1 Conn=Wye Model=1 kV=2.4 kW=' || (10 + c_custkey % 37) || ' kvar=5' || CASE WHEN c_custkey % 3 = 0 THEN '\\nLoad.s' || c_custkey || '.yearly=early' || (c_custkey % 5) ELSE '' END"
_RULE = "'batchedit load.s' || p_partkey || '[0-4] growth=g' || p_partkey"
_STEP = "'batchedit load.S' || r_regionkey || '.* yearly=reg' || r_regionkey || '  ! by the first digit\\nLoad.s' || (11 * r_regionkey + 1) || '.Yearly=one' || r_regionkey || '\\nSolve mode=daily number=' || (24 + r_regionkey) || ' stepsize=1h'"


def script_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the whole script."""

    def make(folder: str) -> None:
        regulators = as_text(A.table(spark, sf_dir, "supplier"), "s_suppkey", _REGULATOR, f"{folder}/deep/regulators")
        loads = as_text(A.table(spark, sf_dir, "customer"), "c_custkey", _LOAD, f"{folder}/deep/loads")
        rules = as_text(A.table(spark, sf_dir, "part"), "p_partkey", _RULE, f"{folder}/deep/rules")
        steps = as_text(A.table(spark, sf_dir, "region"), "r_regionkey", _STEP, f"{folder}/deep/steps")
        net = one_file(["New object=circuit.net basekv=4.16 Bus1=0", *[f"Redirect ../regulators/{f}" for f in regulators], *[f"redirect (../loads/{f.upper()})" for f in loads]], spark, f"{folder}/deep/net")
        after = ["batchedit load..*7 growth=seven", *[f"Redirect ../steps/{f}  ! runs" for f in steps], "batchedit load..*2 yearly=never"]
        file = one_file(["New Line.Old Bus1=a Bus2=b Length=1", "Solve", "Clear", f'Compile "../deep/net/{net}"', *[f"Redirect ../rules/{f}" for f in rules], *after], spark, f"{folder}/master")
        S.statements(S.script(spark, f"{folder}/master/{file}")).write.parquet(f"{folder}/statements")

    return spark.read.parquet(f"{made_once(spark, 'script', sf_dir, make)}/statements")


@query("""
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'regcontrol' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'load', count(*) FROM customer UNION ALL SELECT 'edit', count(*) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'batchedit', count(*) + 2 FROM part UNION ALL SELECT unnest(['batchedit', 'edit', 'solve']), count(*) FROM region UNION ALL SELECT unnest(['circuit', 'compile']), 1) GROUP BY kind""")
def script_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by kind of a script that compiles a file that redirects; what stood before Clear is gone."""
    return script_of(spark, sf_dir).filter("kind <> 'redirect'").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'S' || c_custkey AS name, CASE WHEN c_custkey % 10 = 7 THEN 'seven' WHEN c_custkey >= 10 AND c_custkey % 10 <= 4 AND c_custkey // 10 IN (SELECT p_partkey FROM part) THEN 'g' || (c_custkey // 10) END AS growth FROM customer")
def script_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads after as many bulk edits as there are parts."""
    stmts = script_of(spark, sf_dir)
    return S.edited(S.loads(stmts).select("name"), stmts, "load", "growth", "growth")


@query("""
WITH ev AS (SELECT c_custkey AS k, -1 AS run, 0 AS ord, 'early' || (c_custkey % 5) AS value FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, r_regionkey, 1, 'reg' || r_regionkey FROM customer JOIN region ON starts_with(CAST(c_custkey AS VARCHAR), CAST(r_regionkey AS VARCHAR))
  UNION ALL SELECT c_custkey, r_regionkey, 2, 'one' || r_regionkey FROM customer JOIN region ON c_custkey = 11 * r_regionkey + 1)
SELECT CAST(r.r_regionkey AS BIGINT) AS run, 'daily' AS mode, CAST(24 + r.r_regionkey AS INT) AS n, 's' || ev.k AS name, max_by(ev.value, (ev.run, ev.ord)) AS value FROM region r JOIN ev ON ev.run <= r.r_regionkey GROUP BY ALL""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load's shape at each run: edits between two runs are seen by the second alone."""
    stmts = script_of(spark, sf_dir)
    state = S.at_runs(S.loads(stmts).select("name"), stmts, "load", "yearly")
    return state.join(S.runs(stmts).select("run", "mode", "n"), "run").select("run", "mode", "n", "name", "value")


@query("""
WITH own AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN 1 + s_suppkey % 2 WHEN s_suppkey % 4 = 2 THEN 3 + s_suppkey % 5 END AS w FROM supplier)
SELECT 'R' || a.k AS name, 'T' || (a.k - a.k % 9) AS transformer, CAST(max_by(b.w, b.k) AS INT) AS winding FROM own a JOIN own b ON b.k BETWEEN a.k - a.k % 9 AND a.k AND b.w IS NOT NULL GROUP BY a.k""")
def like_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulators that are like one that is like another, nine in a chain."""
    return S.regulators(script_of(spark, sf_dir))
