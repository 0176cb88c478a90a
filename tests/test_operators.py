"""Single operators on small invented inputs."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import flow, graph, placement, series
from gridloom.operators.order import numbered
from gridloom.sources import statements as S
from gridloom.streaming import barrier

MASTER = """! invented feeder
New object=circuit.demo
~ basekv=4.16 Bus1=src
Redirect loads.txt

New Line.A1 Bus1=src.1.2.3 Bus2=10.1.2.3 LineCode=c1 Length=0.3
New Line.A2 Phases=1 Bus1=10.1 Bus2=20.1 Length=0.2
New Line.Sw1 phases=3 Bus1=10.1.2.3 Bus2=30_OPEN.1.2.3 Length=0.001
New Transformer.reg1 phases=1 windings=2 buses=[10.1 10r.1] kvas=[2000 2000]
New Transformer.x1 phases=3
~ wdg=1 bus=20 kva=150
~ wdg=2 bus=61 kva=150
New Line.A3 Phases=1 Bus1=10r.1 Bus2=40.1 LineCode=c2 Length=0.4
New RegControl.r1 transformer=reg1 winding=2 vreg=120
New RegControl.r2 like=r1
New Capacitor.c1 Bus1=20.1 phases=1 kVAR=50 kV=2.4

~ orphan
"""
LOADS = """New Load.S20a Bus1=20.1 Phases=1 Conn=Wye Model=1 kV=2.4 kW=40 kvar=20\r
new load.low Bus1=20.1 Phases=1 Conn=Wye Model=1 kV=2.4 kW=40 kvar=20
New Load.S10 Bus1=10.1.2.3 Phases=3 Conn=Delta Model=5 kV=4.16 kW=35 kvar=15
New Load.bad Bus1=10 kW=1
New Load.S40 Bus1=40 Phases=1 Conn=Wye Model=2 kV=2.4 kW=10 kvar=5
"""


@pytest.fixture(scope="module")
def stmts(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("model")
    (at / "master.dss").write_text(MASTER)
    (at / "Loads.TXT").write_text(LOADS, newline="")
    paths = S.include_paths(spark, f"file://{at}/master.dss")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["master.dss", "Loads.TXT"]
    return S.statements(S.lines(spark, paths)).cache()


def test_statements(stmts):
    kinds = {r["kind"]: r["n"] for r in stmts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"circuit": 1, "redirect": 1, "line": 3, "switch": 1, "transformer": 2, "regcontrol": 2, "capacitor": 1, "load": 4, "other": 2}
    assert S.source(stmts).first().asDict() == {"name": "demo", "base_kv": 4.16, "bus": "src"}


def test_typed_tables(stmts):
    lines = {r["name"]: r for r in S.line_sections(stmts).collect()}
    assert lines["A1"]["phases"] == 3 and lines["A1"]["linecode"] == "c1" and lines["A2"]["linecode"] is None
    made = {r["name"]: r for r in S.transformers(stmts).collect()}
    assert made["reg1"]["buses"] == ["10.1", "10r.1"] and made["reg1"]["kva"] == [2000, 2000] and made["x1"]["kva"] == [150, 150] and made["x1"]["buses"] == []
    assert {(r["name"], r["transformer"], r["winding"]) for r in S.regulators(stmts).collect()} == {("r1", "reg1", 2), ("r2", "reg1", 2)}
    assert S.capacitors(stmts).first()["kvar"] == 50
    loads = {r["name"]: r for r in S.loads(stmts).collect()}
    assert set(loads) == {"S20a", "S10", "S40"} and loads["S10"]["phase"] == "ABC" and loads["S20a"]["phase"] == "A" and loads["S40"]["phase"] == "Unknown"
    assert [r["name"] for r in S.rejects(stmts).collect()] == ["bad"]
    assert {(r["id"], r["src"], r["dst"]) for r in S.edges(stmts).collect()} == {("A1", "src", "10"), ("A2", "10", "20"), ("Sw1", "10", "30_OPEN"), ("reg1", "10", "10r"), ("A3", "10r", "40")}
    nodes = {r["id"]: r for r in S.nodes(stmts).collect()}
    assert nodes["30_OPEN"]["kind"] == "open_tie" and nodes["10r"]["kind"] == "regulator" and nodes["10"]["base_bus"] == 10 and nodes["10"]["phases_union"] == ["A", "B", "C"]


def test_placement_of_the_model(spark, stmts):
    loads = S.loads(stmts).withColumn("load_seq", F.col("pos").cast("long"))
    out = placement.HybridPlacement(3).select(loads, S.edges(stmts), "src").orderBy("pick").collect()
    assert len(out) == 3 and all(r["depth"] in (1, 2) for r in out) and {r["name"]: r["on_backbone"] for r in out}["S20a"]


def test_rpn(spark):
    given = {"1 2 +": 3.0, "0.00625 7 * 1 +": 1.04375, "1 3600 /": 1 / 3600, "1 +": None, "2 0 /": None, "": None}
    got = spark.createDataFrame([(k,) for k in given], "e string").select("e", T.rpn(F.col("e")).alias("v")).collect()
    assert {r["e"]: r["v"] for r in got} == given


def brute_tree(pairs, source):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    parent, depth, queue, order = {source: None}, {source: 0}, deque([source]), []
    branch, nxt = {source: 0}, 1
    while queue:
        n = queue.popleft()
        order.append(n)
        new = [m for m in sorted(near.get(n, ())) if m not in parent]
        for m in new:
            parent[m], depth[m] = n, depth[n] + 1
            branch[m] = branch[n] if len(new) == 1 else nxt
            nxt += len(new) > 1
            queue.append(m)
    return parent, depth, branch


@pytest.mark.parametrize("seed", [0, 1])
def test_rooted_with_cycles(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(i)), str(i)) for i in range(1, 40)] + [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(8)] + [("x", "y")]
    pairs = [(a, b) for a, b in pairs if a != b]
    tree = graph.rooted(graph.adjacency(spark.createDataFrame(pairs, "src string, dst string")), "0")
    parent, depth, branch = brute_tree(pairs, "0")
    got = {r["node"]: r for r in tree.collect()}
    assert {n: r["parent"] for n, r in got.items()} == parent and {n: r["depth"] for n, r in got.items()} == depth
    assert {r["node"]: r["branch"] for r in graph.branches(tree).collect()} == branch


def test_rooted_loses_no_level(spark):
    near = graph.adjacency(spark.createDataFrame([("0", "1"), ("1", "2"), ("2", "3")], "src string, dst string"))
    with pytest.raises(ValueError):
        graph.rooted(near, "0", 2)
    assert graph.rooted(near, "0", 4).count() == 4


def test_rooted_by_parent(spark):
    rows = [("0", None)] + [(str(i), str(i - 1)) for i in range(1, 30)] + [("x", "5"), ("lost", "nowhere"), ("lost2", "lost")]
    got = {r["node"]: r for r in graph.rooted_by_parent(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert set(got) == {str(i) for i in range(30)} | {"x"} and got["x"]["depth"] == 6 and got["29"]["ancestors"] == [str(i) for i in range(30)]
    with pytest.raises(ValueError):
        graph.rooted_by_parent(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 5)


def test_sums_on_a_deep_tree(spark):
    """A chain of 300 nodes and a few branches: sums below and above, against plain ones and those over ancestors."""
    rng = random.Random(2)
    parent = {str(i): str(i - 1) for i in range(1, 300)} | {f"b{i}": str(rng.randrange(300)) for i in range(60)}
    value = {n: float(rng.randrange(9)) for n in ["0", *parent]}
    below, above = dict.fromkeys(value, 0.0), {}
    for n in value:
        at = n
        while at is not None:
            below[at] += value[n]
            above[n] = above.get(n, 0.0) + value[at]
            at = parent.get(at)
    rows = spark.createDataFrame([("0", None), *parent.items()], "node string, parent string")
    values = spark.createDataFrame(list(value.items()), "node string, v double")
    assert {r["node"]: r["total"] for r in graph.rolled_up(rows, values, "node", {"v": "total"}).collect()} == below
    assert {r["node"]: r["distance"] for r in graph.summed_down(rows, values, "v").collect()} == above
    tree = graph.rooted_by_parent(rows)
    assert {r["node"]: r["downstream"] for r in graph.subtree_sums(tree, values, "node", "v").collect()} == below
    assert {r["node"]: r["distance"] for r in graph.path_sums(tree, values, "v").collect()} == above
    for loop in (graph.rolled_up, lambda *x: graph.summed_down(x[0], x[1], "v", most_rounds=x[4])):
        with pytest.raises(ValueError):
            loop(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), values, "node", {"v": "total"}, 4)


def test_numbered_groups(spark):
    rows = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(50)], "g string, i int")
    got = numbered(rows, "i", by=("g",)).collect()
    assert len(got) == 150 and all(r["n"] == r["i"] for r in got)


def test_zip_needs_equal_counts(spark):
    with pytest.raises(ValueError):
        series.zipped(spark.range(3), ["id"], spark.range(2), ["id"])


def test_barrier_last_wins_and_waits(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5.0), (1, "a", 2, 6.0), (1, "b", 1, 1.0), (2, "a", 1, 9.0)], "tick long, meter string, at long, v double")
    got = series.barrier(rows, "tick", "meter", ["at"], ["v"], 2).collect()
    assert {(r["tick"], r["meter"], r["v"]) for r in got} == {(1, "a", 6.0), (1, "b", 1.0)}
    assert series.incomplete(rows, "tick", "meter", 2).collect()[0]["tick"] == 2


def test_stream_sends_a_tick_once_across_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def go(name, rows):
        (source / name).write_text("\n".join(f'{{"tick": {t}, "meter": "{m}", "at": {a}, "v": {v}}}' for t, m, a, v in rows))
        stream = barrier.replayed(spark, str(source), "tick long, meter string, at long, v double")
        barrier.appended(barrier.completed(stream, "tick", "meter", "at", ["v"], 2), str(out), f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r["tick"], r["meter"], r["v"]) for r in spark.read.parquet(str(out)).collect())

    assert go("1.json", [(1, "a", 1, 1.0), (2, "a", 1, 5.0), (1, "a", 3, 2.0), (1, "b", 1, 3.0)]) == [(1, "a", 2.0), (1, "b", 3.0)]
    assert go("2.json", [(1, "a", 9, 8.0), (1, "b", 9, 8.0), (2, "b", 1, 6.0), (3, "a", 1, 1.0)]) == [(1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0), (2, "b", 6.0)]


def test_stream_tells_ticks_at_their_end(spark, tmp_path):
    """Later readings count, incomplete ticks are told, and what comes after the end is dropped."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def go(name, rows):
        (source / name).write_text("\n".join(f'{{"tick": "2020-01-0{d} 00:00:00", "ts": "2020-01-0{d} {h:02}:00:00", "meter": "{m}", "at": {h}, "v": {v}}}' for d, h, m, v in rows))
        stream = barrier.replayed(spark, str(source), "tick timestamp, ts timestamp, meter string, at long, v double").withWatermark("ts", "0 seconds")
        stream = stream.withColumn("end", F.col("tick") + F.expr("INTERVAL 1 DAY"))
        barrier.appended(barrier.closed(stream, "tick", "meter", "at", ["v"], 2, "end"), str(out), f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r["tick"].day, r["meter"], r["v"], r["complete"]) for r in spark.read.parquet(str(out)).collect()) if out.exists() else []

    assert go("1.json", [(1, 3, "a", 1.0), (1, 1, "b", 2.0), (1, 5, "a", 3.0)]) == []
    assert go("2.json", [(1, 4, "a", 9.0), (1, 6, "b", 4.0), (2, 1, "a", 5.0)]) == [(1, "a", 3.0, True), (1, "b", 4.0, True)]
    assert go("3.json", [(1, 7, "a", 8.0), (4, 1, "b", 6.0)]) == [(1, "a", 3.0, True), (1, "b", 4.0, True), (2, "a", 5.0, False)]


def test_paced_replay(spark):
    sent = spark.createDataFrame([(t, m) for t in range(5) for m in "ab"], "timestamp long, meter string")
    run = barrier.paced(spark, sent, 20).writeStream.format("memory").queryName("paced").start()
    try:
        until = time.time() + 60
        while spark.table("paced").count() < 10 and time.time() < until:
            time.sleep(0.2)
    finally:
        run.stop()
    assert sorted(map(tuple, spark.table("paced").collect())) == [(t, m) for t in range(5) for m in "ab"]


def test_tick_voltages(spark):
    """Against sums over every way, and a tick beyond what is linear is dropped."""
    parent, r = {"1": "0", "2": "1", "3": "1", "4": "2"}, {"1": 0.5, "2": 0.25, "3": 1.0, "4": 0.125}
    tree = graph.rooted_by_parent(spark.createDataFrame([("0", None), *parent.items()], "node string, parent string"))
    lines = spark.createDataFrame([(n, x, 2 * x) for n, x in r.items()], "node string, r double, x double")
    read = [(t, f"m{n}", n, p * t, 0.5 * p) for t in (1, 2) for n, p in (("2", 10.0), ("3", 4.0), ("4", 6.0))] + [(9, "m4", "4", 1e6, 0.0), (9, "m3", "3", 1.0, 0.0)]
    way = lambda n: [n, *way(parent[n])] if n in parent else []
    rows = spark.createDataFrame(read, "tick int, load_name string, node string, p_kw double, q_kvar double")
    got = {(x["tick"], x["load_name"]): x for x in flow.telemetry(rows, tree, lines, 100.0).collect()}
    assert set(got) == {(t, m) for t, m, *_ in read if t < 9}
    for t, m, n, p, q in read:
        if t < 9:
            below = lambda at, k: sum(x[k] for x in read if x[0] == t and at in way(x[2]))  # noqa: B023, E731
            v = 100 - sum((r[a] * below(a, 3) + 2 * r[a] * below(a, 4)) / 100 for a in way(n))
            assert got[t, m]["bus_voltage_v"] == pytest.approx(v) and got[t, m]["bus_voltage_pu"] == pytest.approx(v / 100) and got[t, m]["current_a"] == pytest.approx((p * p + q * q) ** 0.5 * 1000 / v)
    assert {x["tick"]: x["converged"] for x in flow.tick_voltages(tree, lines, rows, 100.0).collect()} == {1: True, 2: True, 9: False}


def test_linear_voltages(spark):
    tree = graph.rooted(graph.adjacency(spark.createDataFrame([("0", "1"), ("1", "2")], "src string, dst string")), "0")
    lines = spark.createDataFrame([("1", 0.1, 0.2), ("2", 0.3, 0.1)], "node string, r double, x double")
    loads = spark.createDataFrame([("1", 10.0, 0.0), ("2", 5.0, 4.0)], "node string, p double, q double")
    got = {r["node"]: r["v"] for r in flow.linear_voltages(tree, lines, loads, 100.0).collect()}
    assert got["0"] == 100 and got["1"] == pytest.approx(100 - (1.5 + 0.8) / 100) and got["2"] == pytest.approx(got["1"] - (1.5 + 0.4) / 100)
