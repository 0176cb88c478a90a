"""Files in, files out."""

import json

import pytest

from gridloom.operators import series
from gridloom.sources import documents as D
from gridloom.sources import statements as S
from gridloom.streaming import barrier


def test_profiles_become_messages(spark, tmp_path):
    for k, n in (("b", 3), ("a", 2)):
        rows = "\n".join(f"2020-01-01 00:0{i}:00,{i}.5,0.{i},240,{k == 'a'}" for i in range(n))
        (tmp_path / f"synthetic_{k}.csv").write_text("datetime,Global_active_power,Global_reactive_power,Voltage,Global_intensity\n" + rows.replace("True", "1.5").replace("False", "2.5"))
    meters = spark.createDataFrame([("M002", "S2", 2), ("M001", "S1", 1)], "meter_id string, load_name string, bus long")
    read = D.profiles(spark, f"file://{tmp_path}/synthetic_*.csv")
    got = sorted((r["timestamp"], r["meter_id"], r["p_kw"], r["current"]) for r in D.messages(read, meters).collect())
    assert got == [(0, "M001", 0.5, 1.5), (0, "M002", 0.5, 2.5), (1, "M001", 1.5, 1.5), (1, "M002", 1.5, 2.5)]
    sent = barrier.keyed_json(D.messages(read, meters)).filter("key = 'M001'").collect()
    assert {json.loads(r["value"])["load_name"] for r in sent} == {"S1"}
    with pytest.raises(ValueError):
        D.messages(read, meters.limit(1)).collect()


def test_profiles_keep_the_order_of_their_rows(spark, tmp_path):
    rows = [("16/12/2006 17:24:00", 1.0), ("02/01/2007 00:00:00", 2.0), ("16/12/2006 17:24:00", 3.0)]
    (tmp_path / "synthetic_1.csv").write_text("datetime,Global_active_power,Global_reactive_power,Voltage,Global_intensity\n" + "".join(f"{t},{p},0,240,1\n" for t, p in rows))
    meters = spark.createDataFrame([("M001", "S1", 1)], "meter_id string, load_name string, bus long")
    got = D.messages(D.profiles(spark, f"file://{tmp_path}/synthetic_*.csv"), meters).orderBy("timestamp").collect()
    assert [(r["datetime"], r["p_kw"]) for r in got] == rows


def test_files_by_their_whole_path(spark, tmp_path):
    (tmp_path / "su b" / "x").mkdir(parents=True)
    (tmp_path / "ma%20 ster+1.dss").write_text('New object=circuit.c basekv=1 Bus1=a\nRedirect su b/Loads.dss ! all\nredirect "SU B/x/../loads.dss"\nRedirect su b/x/LOADS.DSS\n'.replace("SU B", "su b"))
    (tmp_path / "su b" / "Loads.dss").write_text("New Load.one Bus1=1\n")
    (tmp_path / "su b" / "x" / "loads.dss").write_text("New Load.two Bus1=1\n")
    master = f"file://{tmp_path}/ma%20 ster+1.dss"
    st = S.statements(S.lines(spark, S.include_paths(spark, master)))
    assert [(r["file_ord"], r["name"]) for r in st.filter("kind IN ('load', 'circuit')").orderBy("file_ord").collect()] == [(0, "c"), (1, "one"), (2, "one"), (3, "two")]
    (tmp_path / "bad.dss").write_text("Redirect nowhere.dss\n")
    with pytest.raises(FileNotFoundError):
        S.include_paths(spark, f"file://{tmp_path}/bad.dss")


def test_states_edits_and_units(spark, tmp_path):
    text = """New object=circuit.c basekv=1 Bus1=1
New Line.Sw7 phases=3 Bus1=1 Bus2=2 switch=yes Length=1
New Line.Sw8 phases=3 Bus1=2 Bus2=3 switch=yes Length=1
New Line.L1 phases=3 Bus1=1 Bus2=3 Length=1
New Line.L2 phases=3 Bus1=1 Bus2=3
open Line.SW7 terminal=2
Open line.sw8 terminal=2
close Line.Sw8
New Load.B Bus1=2.1 Phases=1 Conn=Wye Model=1 kV=2 kW=5 kvar=1
New Load.A Bus1=10.1 Phases=1 Conn=Wye Model=1 kV=2 kW=4 kvar=1
New Load.C Bus1=2.2 Phases=1 Conn=Wye Model=1 kV=2 kW=3 kvar=1
Load.b.kW=7  kvar=2 ! more
batchedit load..* daily=flat
load.A.Daily=own
New Generator.G Bus1=3 kW=10 Duty=Sun
New LoadShape.sun npts=2 Interval=(1 3600 /) mult=(file=s.csv)
Solve mode=DutyCycle number=2 stepsize=5s
"""
    (tmp_path / "m.dss").write_text(text)
    st = S.statements(S.lines(spark, [f"file://{tmp_path}/m.dss"])).cache()
    assert {(r["name"], r["closed"]) for r in S.switches(st).collect()} == {("Sw7", False), ("Sw8", True)}
    assert {r["id"] for r in S.edges(st).collect()} == {"Sw8", "L1"}
    assert [r["name"] for r in S.loads(st).orderBy("load_seq").collect()] == ["B", "C", "A"]
    daily = S.edited(S.edited(S.loads(st), st, "load", "daily", "daily"), st, "load", "kw", "base_kw")
    assert {(r["name"], r["daily"], r["base_kw"]) for r in daily.collect()} == {("A", "own", 4.0), ("B", "flat", 7.0), ("C", "flat", 3.0)}
    values = spark.createDataFrame([("SUN", 0, 0.5), ("SUN", 1, 1.0)], "shape string, step long, mult double")
    got = series.dispatched(S.generators(st), values, S.shapes(st)).orderBy("step").collect()
    assert [(r["t_s"], r["kw"]) for r in got] == [(0.0, -5.0), (1.0, -10.0)]
    assert [tuple(r)[2:] for r in S.solves(st).collect()] == [("dutycycle", 2, 5.0)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "loads.json").write_text(json.dumps([{"name": "S1", "bus": 1, "base_kw": 40.0}, {"name": "S2", "bus": 2}]))
    rows = D.json_table(spark, f"file://{tmp_path}/loads.json", D.LOADS)
    assert {(r["name"], r["bus"], r["base_kw"]) for r in rows.collect()} == {("S1", 1, 40.0), ("S2", 2, None)}
    D.write_json(rows, f"file://{tmp_path}/out")
    assert spark.read.schema(D.LOADS).json(f"file://{tmp_path}/out").count() == 2


def test_network_document(spark, tmp_path):
    text = "New object=circuit.demo basekv=4.16 Bus1=a\nNew Line.L1 Bus1=a.1 Bus2=b.1 Length=1\nNew Transformer.T1 buses=[b c] kva=50\nNew Capacitor.C1 Bus1=b kVAR=10 kV=2.4\nNew RegControl.R1 transformer=T1 winding=2\n"
    (tmp_path / "m.dss").write_text(text)
    st = S.statements(S.lines(spark, [f"file://{tmp_path}/m.dss"]))
    path = f"file://{tmp_path}/network"
    D.write_network(path, S.source(st), S.nodes(st), S.edges(st), S.transformers(st), S.capacitors(st), S.regulators(st))
    n = D.json_table(spark, path, D.NETWORK).first()
    assert n["source"]["bus"] == "a" and {e["id"] for e in n["edges"]} == {"L1", "T1"} and n["assets"]["transformers"][0]["name"] == "T1"
    assert {x["id"] for x in n["nodes"]} == {"a", "b", "c"} and n["assets"]["regulators"][0]["winding"] == 2


def test_network_tables(spark, tmp_path):
    """Every part through its folder and back."""
    text = "New object=circuit.demo basekv=4.16 Bus1=a\nNew Line.L1 Bus1=a.1 Bus2=b.1 Length=1\nNew Transformer.T1 buses=[b c] kva=50\nNew Capacitor.C1 Bus1=b kVAR=10 kV=2.4\nNew RegControl.R1 transformer=T1 winding=2\n"
    (tmp_path / "m.dss").write_text(text)
    st = S.statements(S.lines(spark, [f"file://{tmp_path}/m.dss"]))
    path = f"file://{tmp_path}/network"
    D.write_network_tables(path, source=S.source(st), nodes=S.nodes(st), edges=S.edges(st), transformers=S.transformers(st), capacitors=S.capacitors(st), regulators=S.regulators(st))
    read = {name: sorted(map(tuple, D.network_table(spark, path, name).collect()), key=str) for name in D.PARTS}
    assert read["source"] == [("demo", 4.16, "a")] and [e[:4] for e in read["edges"]] == [("L1", "a", "b", "line"), ("T1", "b", "c", "transformer")]
    assert [n[0] for n in read["nodes"]] == ["a", "b", "c"] and read["transformers"] == [("T1", ["b", "c"], [50.0])]
    assert read["capacitors"] == [("C1", "b", 10.0, 2.4)] and read["regulators"] == [("R1", "T1", 2)]


def test_profiles_in_folders(spark, tmp_path):
    """A household's files follow each other by name."""
    head = "datetime,Global_active_power,Global_reactive_power,Voltage,Global_intensity\n"
    for name, rows in (("b/part-1", [3.0]), ("b/part-0", [1.0, 2.0]), ("a/part-9", [7.0, 8.0, 9.0, 10.0])):
        at = tmp_path / "p" / f"{name}.csv"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(head + "".join(f"t,{p},0,240,1\n" for p in rows))
    meters = spark.createDataFrame([("M1", "x", 1), ("M2", "y", 2)], "meter_id string, load_name string, bus long")
    got = D.messages(D.profiles(spark, f"file://{tmp_path}/p/*", folders=True), meters).orderBy("meter_id", "timestamp").collect()
    assert [(r["meter_id"], r["p_kw"]) for r in got] == [("M1", 7.0), ("M1", 8.0), ("M1", 9.0), ("M2", 1.0), ("M2", 2.0), ("M2", 3.0)]


def test_line_codes_coordinates_shapes(spark, tmp_path):
    (tmp_path / "m.dss").write_text("New linecode.1 nphases=2 BaseFreq=60\n~ rmatrix = [0.1 | 0.2 0.3]\n~ xmatrix = (1 | 2 3)\nNew linecode.2 nphases=1 rmatrix=[9]\n")
    got = S.line_codes(S.statements(S.lines(spark, [f"file://{tmp_path}/m.dss"]))).collect()
    assert sorted(map(tuple, got), key=str) == [("1", 1, 1, 0.1, 1.0, None), ("1", 2, 1, 0.2, 2.0, None), ("1", 2, 2, 0.3, 3.0, None), ("2", 1, 1, 9.0, None, None)]
    (tmp_path / "at.dat").write_text("1   10.5  20\n\n2 3 4\nbad line here\n")
    assert sorted(map(tuple, S.coordinates(spark, f"file://{tmp_path}/at.dat").collect())) == [("1", 10.5, 20.0), ("2", 3.0, 4.0)]
    (tmp_path / "shape.csv").write_text("0.5\n1.0\n\n0.25\n")
    shape = S.load_shape(spark, f"file://{tmp_path}/shape.csv", 60.0).orderBy("step").collect()
    assert [(r["t_s"], r["mult"]) for r in shape] == [(0.0, 0.5), (60.0, 1.0), (120.0, 0.25)]
