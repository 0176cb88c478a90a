"""Lines of files of any size, continuation, includes at any depth, chains of likeness, edits and runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators.order import numbered, quantiles, running
from gridloom.sources import statements as S


@pytest.fixture
def small_splits(spark):
    """Files are read in parts of some hundred bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def brute_merge(lines):
    """pos, cmd, n_lines by one run through the lines."""
    out, open_ = [], False
    for i, raw in enumerate(lines):
        t = raw.strip(" ")
        if not t or t.startswith("!"):
            open_ = False
        elif t.startswith("~") and open_:
            out[-1][1].append(re.sub(r"^~\s*", "", t))
        else:
            out.append((i, [re.sub(r"^~\s*", "", t)]))
            open_ = True
    return [(i, " ".join(x), len(x)) for i, x in out]


def text_of(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["", "! remark", "New Line.a", "~ b=1", "~ c", "~", "  ~ d ", "x"]) + (f" {i}" if rng.random() < 0.7 else "") for i in range(n)]


@pytest.mark.parametrize("block", [1, 2, 7, 8192])
def test_merged_in_blocks(spark, block):
    texts = {k: text_of(120, k) for k in range(4)} | {9: ["~ only", "~ these", *["~ x"] * 20], 10: ["!", "", "~ a", "~ b"], 11: ["c", *["~ y"] * 9, "", "~ z"], None: ["of null", "~ too"]}
    rows = spark.createDataFrame([(k, i, t) for k, lines in texts.items() for i, t in enumerate(lines)], "f int, pos int, line string").repartition(5)
    got = sorted(map(tuple, S.merged(rows, "f", "pos", "line", block).select("f", "pos", "cmd", "n_lines").collect()), key=repr)
    assert got == sorted(((k, *r) for k, lines in texts.items() for r in brute_merge(lines)), key=repr)


def test_a_file_in_several_splits(spark, small_splits, tmp_path):
    """The same statements as from the file in one part, and lines keep their numbers, however they end."""
    lines = text_of(400, 5)
    (tmp_path / "a.dss").write_bytes(b"".join(t.encode() + random.Random(i).choice([b"\n", b"\r\n"]) for i, t in enumerate(lines)))
    (tmp_path / "b.dss").write_text("one\n~ two\n")
    paths = [f"file://{tmp_path}/{n}.dss" for n in "aba"]
    read = S.lines(spark, paths)
    assert spark.read.text(paths[0]).rdd.getNumPartitions() > 5
    assert [r["line"] for r in read.filter("file_ord = 2").orderBy("pos").collect()] == lines
    assert [r["pos"] for r in read.filter("file_ord = 0").orderBy("pos").collect()] == list(range(400))
    got = [(r["pos"], r["cmd"]) for r in S.statements(read).filter("file_ord = 0").orderBy("pos").collect()]
    assert got == [r[:2] for r in brute_merge(lines)]
    shape = tmp_path / "shape.csv"
    shape.write_text("".join(f"{i}.5\n\n" for i in range(200)))
    assert [(r["step"], r["t_s"], r["mult"]) for r in S.load_shape(spark, f"file://{shape}", 2.0).orderBy("step").collect()] == [(i, 2.0 * i, i + 0.5) for i in range(200)]


def scripts(tmp_path, **files):
    for name, text in files.items():
        at = tmp_path / name.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.with_suffix(".dss").write_text(text)
    return f"file://{tmp_path}/master.dss"


def told(spark, master):
    return [r["line"] for r in S.script(spark, master).orderBy("pos").collect() if not re.match(r"(?i)(redirect|compile)", r["line"])]


def test_script_with_includes_at_any_depth(spark, tmp_path):
    master = scripts(
        tmp_path,
        master="gone\nRedirect side/tail.dss\nCLEAR\nfirst\nRedirect side/tail.dss ! comes back\nCompile (deep/net.dss)\nRedirect more.dss\nlast\n",
        side__tail="in tail\nRedirect leaf.dss\n",
        side__leaf="leaf of side\n",
        deep__net='a\nCompile "under/core.dss"\nRedirect LEAF.dss\nb\n',
        deep__under__core="core\n",
        deep__under__leaf="leaf under\n",
        deep__under__more="more\nRedirect leaf.dss\n",
    )
    assert told(spark, master) == ["first", "in tail", "leaf of side", "a", "core", "leaf under", "b", "more", "leaf under", "last"]
    assert [r["pos"] for r in S.script(spark, master).orderBy("pos").collect()] == list(range(17))


def test_scripts_that_lead_nowhere(spark, tmp_path):
    with pytest.raises(ValueError):
        S.script(spark, scripts(tmp_path / "a", master="Redirect b.dss\n", b="Redirect c.dss\n", c="x\nRedirect B.dss\n"))
    with pytest.raises(FileNotFoundError):
        S.script(spark, scripts(tmp_path / "b", master="Redirect b.dss\n", b="Redirect c.dss\n"))
    assert told(spark, scripts(tmp_path / "c", master="a\nclear\n")) == []


def test_like_chains(spark):
    rows = [("r0", None, 1, "x"), *[(f"R{i}", f"r{i - 1}", 100 + i if i == 5 else None, None) for i in range(1, 40)], ("lost", "nobody", None, "y"), ("own", "lost", 7, None)]
    frame = spark.createDataFrame(rows, "name string, like string, a int, b string")
    got = {r["name"]: (r["a"], r["b"]) for r in S.like_resolved(frame, "name", "like", ["a", "b"]).collect()}
    assert got == {"r0": (1, "x")} | {f"R{i}": (1 if i < 5 else 105, "x") for i in range(1, 40)} | {"lost": (None, "y"), "own": (7, "y")}
    circle = spark.createDataFrame([("a", "b", None, None), ("b", "C", None, None), ("c", "a", None, None)], "name string, like string, a int, b string")
    with pytest.raises(ValueError):
        S.like_resolved(circle, "name", "like", ["a", "b"], 6)


def test_bulk_edits_by_their_letters(spark):
    """Every pattern against every name, whatever plain letters it has."""
    patterns = [".*", "s1.*", "S12", "s1?", "s1*2", ".*9", "s(1|2)2", "s1|s2", r"s\d2", r".*\d5", "[st]1.", ".*[0-4]", "(?:s)33", "s-_1", "abcdefghijkl", "abcdefghijk?l?m*", ".*efghijklmnop", "s{1}4", "^s5$", "", "s6+", "x-.*-y"]
    names = [f"s{i}" for i in range(60)] + [f"T{i}" for i in range(20)] + ["abcdefghijkl", "abcdefghij", "xxabcdefghijklmnop", "s-_1", "S66666", "s", "x-1-y", "x--y", "X-y", ""]
    rules = spark.createDataFrame([(p, k) for k, p in enumerate(patterns)], "pattern string, k int")
    got = sorted((r["name"], r["k"]) for r in S.bulk_hits(spark.createDataFrame([(n,) for n in names], "name string"), rules).collect())
    assert got == sorted((n, k) for n in names for k, p in enumerate(patterns) if re.fullmatch(p, n, re.I))


def test_runs_see_what_stands_before_them(spark, tmp_path):
    text = """New Load.A Bus1=1 Phases=1 Conn=Wye Model=1 kV=2 kW=5 kvar=1
New Load.B Bus1=1 Phases=1 Conn=Wye Model=1 kV=2 kW=5 kvar=1
New Load.C Bus1=1 Phases=1 Conn=Wye Model=1 kV=2 kW=5 kvar=1
Solve
Load.A.yearly=x
Load.A.yearly=y
batchedit load.[ab] yearly=z
Load.B.yearly=own
Solve mode=daily
Solve mode=yearly number=3
load.a.YEARLY=late
Solve
Load.C.yearly=after all
"""
    (tmp_path / "m.dss").write_text(text)
    st = S.statements(S.lines(spark, [f"file://{tmp_path}/m.dss"]))
    got = sorted(map(tuple, S.at_runs(S.loads(st).select("name"), st, "load", "yearly").select("run", "name", "value").collect()))
    assert got == [(1, "a", "z"), (1, "b", "own"), (2, "a", "z"), (2, "b", "own"), (3, "a", "late"), (3, "b", "own")]
    assert [(r["run"], r["mode"], r["n"]) for r in S.runs(st).orderBy("run").collect()] == [(0, "snapshot", 1), (1, "daily", 1), (2, "yearly", 3), (3, "snapshot", 1)]
    none = st.filter("kind <> 'solve'")
    assert S.at_runs(S.loads(none).select("name"), none, "load", "yearly").collect() == []


def test_running_totals(spark):
    rows = [(i % 13, i, i % 5) for i in range(300)]
    got = {r["k"]: r["total"] for r in running(spark.createDataFrame(rows, "g int, k int, v int"), "v", "g", "k").collect()}
    total, want = 0, {}
    for _, k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want
    assert running(spark.createDataFrame([], "k int, v int"), "v", "k").collect() == []


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40, [float(i * i % 37) for i in range(101)], [-1.5, None, 2.5, 2.5, None, 9.0]])
def test_quantiles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    assert quantiles(frame, "v", at) == frame.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]
    assert quantiles(frame.filter("v > 1e9"), "v", at) is None
    assert numbered(frame.filter("v > 1e9"), "v").collect() == []
