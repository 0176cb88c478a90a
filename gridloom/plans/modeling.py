"""Queries over model text: the driver's tables are written as statements, and read back through the sources.

Parts are lines and switches of a tree, suppliers transformers and regulators, nations capacitors, regions generators, customers loads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import graph, series
from gridloom.plans import adapters as A
from gridloom.plans.registry import query
from gridloom.plans.texts import as_text, made_once, one_file
from gridloom.sources import documents as D
from gridloom.sources import statements as S
from gridloom.sources.shared import shared_dir

_PARENT = "CASE WHEN p_partkey % 2 = 1 THEN (p_partkey - 1) {div} 2 ELSE p_partkey {div} 3 END"
_PHASE = "1 + p_partkey % 3"
_LINE = f"""CASE p_partkey % 10
  WHEN 7 THEN 'New Line.Sw' || p_partkey || ' phases=3 Bus1=' || p || ' Bus2=' || p_partkey || ' switch=yes Length=0.001'
    || CASE WHEN p_partkey % 20 = 17 THEN '\\nopen Line.SW' || p_partkey || ' terminal=2' ELSE '' END || CASE WHEN p_partkey % 40 = 37 THEN '\\nclose line.sw' || p_partkey ELSE '' END
  WHEN 3 THEN 'New Line.L' || p_partkey || ' Bus1=' || p || '.1.2.3 Bus2=' || p_partkey || '.1.2.3 LineCode=' || (p_size % 12) || ' Length=' || p_size
  WHEN 5 THEN 'New Line.L' || p_partkey || ' Phases=1\\n! a remark ends it not, a line does\\n' || 'New Line.M' || p_partkey || ' Phases=1\\n~ Bus1=' || p || '.' || ({_PHASE}) || ' Bus2=' || p_partkey || '.' || ({_PHASE}) || '\\n~ Length=' || p_size
  WHEN 9 THEN 'New Line.L' || p_partkey || ' Phases=1 Bus1=' || p || '.1 Bus2=' || p_partkey || '.1'
  ELSE 'New Line.L' || p_partkey || ' Phases=1 Bus1=' || p || '.' || ({_PHASE}) || ' Bus2=' || p_partkey || '.' || ({_PHASE}) || ' LineCode=' || (p_size % 12) || ' Length=' || p_size || '  ! laid' END"""
_TRANSFORMER = """CASE WHEN s_suppkey % 3 = 0 THEN 'New Transformer.T' || s_suppkey || ' Phases=3 Windings=2\\n~ wdg=1 bus=' || s_suppkey || ' kva=150\\n~ wdg=2 bus=x kva=75'
  ELSE 'New Transformer.T' || s_suppkey || ' phases=1 windings=2 buses=[' || s_suppkey || '.1 ' || s_suppkey || 'r.1] kvas=[' || (100 + s_suppkey) || ' 50]' END
  || CASE s_suppkey % 4 WHEN 0 THEN '\\nNew RegControl.R' || s_suppkey || ' transformer=T' || s_suppkey || ' winding=2 vreg=120' WHEN 1 THEN '\\nNew RegControl.R' || s_suppkey || ' like=r' || (s_suppkey - 1) ELSE '' END"""
_CAPACITOR = "'New Capacitor.C' || n_nationkey || ' Bus1=' || n_nationkey || '.1 phases=1 kVAR=' || (50 + n_nationkey) || CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE ' kV=2.4' END"
_GENERATOR = "'New Generator.G' || r_regionkey || ' Bus1=' || r_regionkey || ' kV=4.16  kW=' || (100 * (r_regionkey + 1)) || '  PF=1  Duty=shape' || (r_regionkey % 2) || '\\nNew storage.B' || r_regionkey || ' Bus1=' || r_regionkey || ' kV=4.16 Duty=SHAPE' || (r_regionkey % 2) || ' kwrated=' || (50 * (r_regionkey + 1))"
_LOAD = """CASE WHEN c_custkey % 9 = 8 THEN 'new load.s' WHEN c_custkey % 11 = 10 THEN 'New Load.bad' ELSE 'New Load.S' END || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN ' Bus1=' || (c_custkey % 50) || ' Phases=3 Conn=Delta' ELSE ' Bus1=' || (c_custkey % 50) || '.' || (1 + c_custkey % 3) || ' Phases=1 Conn=Wye' END
  || ' Model=' || (1 + c_custkey % 3) || ' kV=2.4 kW=' || (10 + c_custkey % 37) || CASE WHEN c_custkey % 11 = 10 AND c_custkey % 9 <> 8 THEN '' ELSE ' kvar=' || (5 + c_custkey % 13) END"""
_EDIT = "CASE WHEN c_custkey % 5 = 0 THEN 'Load.s' || c_custkey || '.Daily=day' || (c_custkey % 4) || '  Yearly=flat !one' END"
_LATE = "CASE WHEN c_custkey % 25 = 0 THEN 'LOAD.S' || c_custkey || '.daily=late' END"
_CIRCUIT = "'! written from tables\nNew object=circuit.grid' || r || '\n~ basekv=' || kv || ' Bus1=' || bus || '\n'"
_SHAPE = "'New Loadshape.shape' || r_regionkey || ' npts=' || (20 + r_regionkey) || CASE r_regionkey % 2 WHEN 0 THEN ' sinterval=60' ELSE ' Interval=(1 60 /)' END || ' mult=(file=' || replace(r_name, ' ', '_') || '.csv)'"
_MONITOR = "'New Monitor.m' || n_nationkey || CASE n_nationkey % 2 WHEN 0 THEN ' Element=Line.L' ELSE ' Line.L' END || n_regionkey || CASE n_nationkey % 3 WHEN 0 THEN '' ELSE ' Terminal=2' END || ' mode=' || (n_nationkey % 6)"
_SOLVE = "CASE r_regionkey WHEN 0 THEN 'solve' WHEN 1 THEN 'Solve mode=dutycycle number=24 stepsize=1m' ELSE 'Solve number=' || (10 * r_regionkey) || ' mode=Daily stepsize=' || r_regionkey || CASE r_regionkey % 2 WHEN 0 THEN 'h' ELSE 's' END END"


def statements_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as text files, a master that redirects to them, and the statements read from these; written once in a session."""

    def make(folder: str) -> None:
        parts = A.table(spark, sf_dir, "part").filter("p_partkey >= 1").withColumn("p", F.expr(_PARENT.format(div="div")))
        circuit = A.table(spark, sf_dir, "part").agg(F.count("*").alias("r"), F.max("p_size").alias("kv"), F.min("p_partkey").alias("bus"))
        tables = [
            ("circuit", circuit, "r", _CIRCUIT),
            ("shapes", A.table(spark, sf_dir, "region"), "r_regionkey", _SHAPE),
            ("monitors", A.table(spark, sf_dir, "nation"), "n_nationkey", _MONITOR),
            ("runs", A.table(spark, sf_dir, "region"), "r_regionkey", _SOLVE),
            ("lines", parts, "p_partkey", _LINE),
            ("transformers", A.table(spark, sf_dir, "supplier"), "s_suppkey", _TRANSFORMER),
            ("capacitors", A.table(spark, sf_dir, "nation"), "n_nationkey", _CAPACITOR),
            ("generators", A.table(spark, sf_dir, "region"), "r_regionkey", _GENERATOR),
            ("loads", A.table(spark, sf_dir, "customer"), "c_custkey", _LOAD),
            ("edits", A.table(spark, sf_dir, "customer"), "c_custkey", _EDIT),
            ("bulk", spark.range(1), "id", "'batchedit load..*1  daily=ones  ! all that end in 1 or 5\nbatchedit load..*5 daily=fives'"),
            ("late", A.table(spark, sf_dir, "customer"), "c_custkey", _LATE),
        ]
        told = [f"Redirect ../{name} text/{f.upper() if name == 'bulk' else f}  ! {name}" for name, rows, key, text in tables for f in as_text(rows, key, text, f"{folder}/{name} text")]
        master = one_file(told, spark, f"{folder}/master")
        S.statements(S.script(spark, f"{folder}/master/{master}")).write.parquet(f"{folder}/statements")

    return spark.read.parquet(f"{made_once(spark, 'model', sf_dir, make)}/statements")


_WIRED = f"""lines AS (SELECT p_partkey AS k, {_PARENT.format(div="//")} AS p, p_partkey % 10 AS m, {_PHASE} AS ph, p_size FROM part WHERE p_partkey >= 1),
sections AS (SELECT k, p, m, CASE WHEN m = 7 THEN 'Sw' WHEN m = 5 THEN 'M' ELSE 'L' END || k AS name, CASE WHEN m IN (3, 7) THEN 3 ELSE 1 END AS phases,
  CASE m WHEN 7 THEN '' WHEN 3 THEN '.1.2.3' ELSE '.' || ph END AS tail, CASE WHEN m = 7 THEN 0.001 ELSE CAST(p_size AS DOUBLE) END AS length, CASE WHEN m IN (5, 7) THEN NULL ELSE CAST(p_size % 12 AS VARCHAR) END AS linecode,
  NOT (m = 7 AND k % 20 = 17 AND k % 40 <> 37) AS closed FROM lines WHERE m <> 9)"""
_KEPT = "c_custkey % 9 <> 8 AND c_custkey % 11 <> 10"


@query("""
SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN p_partkey % 10 = 7 THEN 'switch' ELSE 'line' END AS kind FROM part WHERE p_partkey >= 1 UNION ALL SELECT 'line' FROM part WHERE p_partkey >= 1 AND p_partkey % 10 = 5
  UNION ALL SELECT 'open' FROM part WHERE p_partkey % 20 = 17 UNION ALL SELECT 'close' FROM part WHERE p_partkey % 40 = 37
  UNION ALL SELECT 'transformer' FROM supplier UNION ALL SELECT 'regcontrol' FROM supplier WHERE s_suppkey % 4 < 2 UNION ALL SELECT 'capacitor' FROM nation
  UNION ALL SELECT unnest(['generator', 'storage']) FROM region UNION ALL SELECT CASE WHEN c_custkey % 9 = 8 THEN 'other' ELSE 'load' END FROM customer
  UNION ALL SELECT 'edit' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'edit' FROM customer WHERE c_custkey % 25 = 0
  UNION ALL SELECT unnest(['batchedit', 'batchedit', 'circuit']) UNION ALL SELECT unnest(['loadshape', 'solve']) FROM region UNION ALL SELECT 'monitor' FROM nation) GROUP BY kind""")
def model_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by kind."""
    return statements_of(spark, sf_dir).filter("kind <> 'redirect'").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'grid' || count(*) AS name, CAST(max(p_size) AS DOUBLE) AS base_kv, CAST(min(p_partkey) AS VARCHAR) AS bus FROM part")
def model_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuit's source."""
    return S.source(statements_of(spark, sf_dir))


@query(f"WITH {_WIRED} SELECT name, phases, p || tail AS bus1, k || tail AS bus2, length, linecode FROM sections WHERE m <> 7")
def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sections; those without a length are none."""
    return S.line_sections(statements_of(spark, sf_dir)).drop("file_ord", "pos")


@query(f"WITH {_WIRED} SELECT name, CAST(p AS VARCHAR) AS bus1, CAST(k AS VARCHAR) AS bus2, closed FROM sections WHERE m = 7")
def model_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches, open where the last statement about them opens them."""
    return S.switches(statements_of(spark, sf_dir)).select("name", "bus1", "bus2", "closed")


@query(f"WITH {_WIRED} SELECT closed, count(*) AS n FROM sections WHERE m = 7 GROUP BY 1")
def switch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches by whether they are closed."""
    return S.switches(statements_of(spark, sf_dir)).groupBy("closed").agg(F.count("*").alias("n"))


@query("""
SELECT 'T' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey || '.1,' || s_suppkey || 'r.1' END AS buses, CASE WHEN s_suppkey % 3 = 0 THEN 225.0 ELSE 150.0 + s_suppkey END AS kva, 2 AS n FROM supplier""")
def model_transformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformers with their buses and the sum of their ratings, in both ways to write these."""
    return S.transformers(statements_of(spark, sf_dir)).select("name", F.array_join("buses", ",").alias("buses"), T.total(F.col("kva")).alias("kva"), F.size("kva").alias("n"))


@query("SELECT 'R' || s_suppkey AS name, 'T' || (s_suppkey - s_suppkey % 4) AS transformer, 2 AS winding FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 AND s_suppkey - 1 IN (SELECT s_suppkey FROM supplier)")
def model_regulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulator controls, half of them like another."""
    return S.regulators(statements_of(spark, sf_dir))


@query("SELECT 'C' || n_nationkey AS name, n_nationkey || '.1' AS bus, CAST(50 + n_nationkey AS DOUBLE) AS kvar, 2.4::DOUBLE AS kv FROM nation WHERE n_nationkey % 5 <> 4")
def model_capacitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacitors; those without a voltage are none."""
    return S.capacitors(statements_of(spark, sf_dir))


@query(f"""
SELECT 'S' || c_custkey AS name, c_custkey % 50 AS bus, CASE WHEN c_custkey % 7 = 0 THEN 'ABC' ELSE ['A', 'B', 'C'][1 + c_custkey % 3] END AS phase, CASE WHEN c_custkey % 7 = 0 THEN 'Delta' ELSE 'Wye' END AS connection,
  CAST(1 + c_custkey % 3 AS INT) AS model, CAST(10 + c_custkey % 37 AS DOUBLE) AS base_kw, CAST(5 + c_custkey % 13 AS DOUBLE) AS base_kvar, CAST(row_number() OVER (ORDER BY c_custkey % 50, c_custkey) - 1 AS BIGINT) AS load_seq
FROM customer WHERE {_KEPT}""")
def model_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads in the order of their buses."""
    return S.loads(statements_of(spark, sf_dir)).select("name", "bus", "phase", "connection", "model", "base_kw", "base_kvar", "load_seq")


@query("SELECT 'bad' || c_custkey AS name FROM customer WHERE c_custkey % 11 = 10 AND c_custkey % 9 <> 8")
def model_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load statements that lack a field."""
    return S.rejects(statements_of(spark, sf_dir)).select("name")


@query(f"""
WITH {_WIRED} SELECT name AS id, CAST(p AS VARCHAR) AS src, CAST(k AS VARCHAR) AS dst, CASE WHEN m = 7 THEN 'switch' ELSE 'line' END AS device, length FROM sections WHERE closed
UNION ALL SELECT 'T' || s_suppkey, CAST(s_suppkey AS VARCHAR), s_suppkey || 'r', 'transformer', 0.0 FROM supplier WHERE s_suppkey % 3 <> 0""")
def model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the network; open switches are none."""
    return S.edges(statements_of(spark, sf_dir)).select("id", "src", "dst", "device", "length")


@query(f"""
WITH {_WIRED}, seen AS (SELECT CAST(p AS VARCHAR) AS id, tail FROM sections UNION ALL SELECT CAST(k AS VARCHAR), tail FROM sections
  UNION ALL SELECT unnest([CAST(s_suppkey AS VARCHAR), s_suppkey || 'r']), '.1' FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), '.1' FROM nation)
SELECT id, CAST(regexp_replace(id, '[^0-9]', '', 'g') AS BIGINT) AS base_bus, CASE WHEN id LIKE '%r' THEN 'regulator' ELSE 'bus' END AS kind,
  CASE WHEN bool_or(contains(tail, '1')) THEN 'A' ELSE '' END || CASE WHEN bool_or(contains(tail, '2')) THEN 'B' ELSE '' END || CASE WHEN bool_or(contains(tail, '3')) THEN 'C' ELSE '' END AS phases
FROM seen GROUP BY id""")
def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the phases that any statement gives them."""
    return S.nodes(statements_of(spark, sf_dir)).select("id", "base_bus", "kind", F.array_join("phases_union", "").alias("phases"))


@query(f"""
SELECT 'S' || c_custkey AS name, CASE WHEN c_custkey % 25 = 0 THEN 'late' WHEN c_custkey % 10 = 5 THEN 'fives' WHEN c_custkey % 10 = 1 THEN 'ones' WHEN c_custkey % 5 = 0 THEN 'day' || (c_custkey % 4) END AS daily,
  CASE WHEN c_custkey % 5 = 0 THEN 'flat' END AS yearly FROM customer WHERE {_KEPT}""")
def model_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads' shapes after single and bulk edits, the last one winning."""
    stmts = statements_of(spark, sf_dir)
    return S.edited(S.edited(S.loads(stmts).select("name"), stmts, "load", "daily", "daily"), stmts, "load", "yearly", "yearly")


@query("""
WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step, value AS mult FROM events WHERE event_type IN ('click', 'view')),
u AS (SELECT 'G' || r_regionkey AS name, 'generator' AS device, 100 * (r_regionkey + 1) AS kw, r_regionkey % 2 AS sh FROM region UNION ALL SELECT 'B' || r_regionkey, 'storage', 50 * (r_regionkey + 1), r_regionkey % 2 FROM region)
SELECT u.name, u.device, s.step, s.step * 60.0 AS t_s, round(-u.kw * s.mult, 6) AS kw FROM u JOIN s ON s.event_type = CASE WHEN u.sh = 0 THEN 'click' ELSE 'view' END AND s.step < 24""")
def model_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators and storage as negative loads that follow their shapes, through the run that the text asks for."""
    stmts = statements_of(spark, sf_dir)
    run = S.solves(stmts).filter("mode = 'dutycycle'").first()
    named = F.when(F.col("shape") == "click", "shape0").otherwise("shape1")
    values = series.first_steps(A.table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')").select(F.col("event_type").alias("shape"), "ts", "event_id", F.col("value").alias("mult")), "shape", ["ts", "event_id"], run["n"])
    made = series.dispatched(S.generators(stmts), values.withColumn("shape", named), S.shapes(stmts))
    return made.select("name", "device", "step", "t_s", F.round("kw", 6).alias("kw"))


@query("""
SELECT 'm' || n_nationkey AS item, 'Line.L' || n_regionkey AS told, CASE WHEN n_nationkey % 3 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS a, (n_nationkey % 6)::DOUBLE AS b FROM nation
UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'snapshot' WHEN 1 THEN 'dutycycle' ELSE 'daily' END, NULL, CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 24 ELSE 10 * r_regionkey END, CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE r_regionkey * CASE WHEN r_regionkey % 2 = 0 THEN 3600 ELSE 1 END END FROM region
UNION ALL SELECT 'shape' || r_regionkey, replace(r_name, ' ', '_') || '.csv', 20 + r_regionkey, 60 FROM region""")
def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text says of monitors, runs and shapes."""
    stmts = statements_of(spark, sf_dir)
    number = lambda c: F.col(c).cast("double")
    m = S.monitors(stmts).select(F.col("name").alias("item"), F.col("element").alias("told"), number("terminal").alias("a"), number("mode").alias("b"))
    r = S.solves(stmts).select(F.col("mode").alias("item"), F.lit(None).cast("string").alias("told"), number("n").alias("a"), number("step_s").alias("b"))
    return m.unionByName(r).unionByName(S.shapes(stmts).select(F.col("name").alias("item"), F.col("file").alias("told"), number("npts").alias("a"), number("interval_s").alias("b")))


@query(f"""
WITH RECURSIVE {_WIRED}, near AS (SELECT p AS a, k AS b FROM sections WHERE closed UNION SELECT k, p FROM sections WHERE closed), walk(node, depth) AS (SELECT 0, 0 UNION SELECT n.b, w.depth + 1 FROM walk w JOIN near n ON n.a = w.node WHERE w.depth < 200 AND n.b > w.node)
SELECT CAST(node AS VARCHAR) AS node, CAST(max(depth) AS INT) AS depth FROM walk GROUP BY node""")
def model_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeder's tree from the text: what lies beyond open switches and lines without a length is not reached."""
    edges = S.edges(statements_of(spark, sf_dir)).filter("device <> 'transformer'")
    return graph.rooted(graph.adjacency(edges), "0").select("node", "depth")


@query("""
WITH r AS (SELECT 'line.l' || (user_id % 7) AS element, date_trunc('day', ts) AS day, value FROM events)
SELECT 'm' || n_nationkey AS name, CAST(day AS TIMESTAMP) AS day, round(avg(value), 6) AS kw, round(max(value), 6) AS peak, count(*) AS n FROM nation JOIN r ON r.element = 'line.l' || n_regionkey GROUP BY 1, 2""")
def monitor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each monitor of the text records of its element, by the day."""
    rows = A.table(spark, sf_dir, "events").select(F.concat(F.lit("LINE.l"), (F.col("user_id") % 7).cast("string")).alias("element"), "ts", "value")
    channels = {"kw": F.round(F.avg("value"), 6), "peak": F.round(F.max("value"), 6), "n": F.count("*")}
    return series.recorded(rows, S.monitors(statements_of(spark, sf_dir)), "element", "ts", "day", channels)


@query(f"""
WITH {_WIRED} SELECT name AS id, CAST(p AS VARCHAR) AS "from", CAST(k AS VARCHAR) AS "to", CASE WHEN m = 7 THEN 'switch' ELSE 'line' END AS device, phases, length, linecode FROM sections WHERE closed
UNION ALL SELECT 'T' || s_suppkey, CAST(s_suppkey AS VARCHAR), s_suppkey || 'r', 'transformer', 1, 0.0, NULL FROM supplier WHERE s_suppkey % 3 <> 0""")
def network_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's edges through JSON and back, beside its nodes and assets."""
    stmts, path = statements_of(spark, sf_dir), f"{shared_dir(spark)}/network-{uuid.uuid4().hex}"
    D.write_network_tables(path, source=S.source(stmts), nodes=S.nodes(stmts), edges=S.edges(stmts), transformers=S.transformers(stmts), capacitors=S.capacitors(stmts), regulators=S.regulators(stmts))
    return D.network_table(spark, path, "edges")
