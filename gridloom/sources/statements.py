"""Model text as statements, and statements as typed tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.text import assignments, found, kind, load_terminal, number, object_name, prop, rpn, terminal
from gridloom.operators.order import numbered, running
from gridloom.sources.shared import staged


_INCLUDE = r"(?i)^(redirect|compile)\s*[\s(\"]\s*[\"(]?([^!\")]+)"


def _found_file(spark: SparkSession, folder, name: str, by: str):
    """The path of a file that is named from a folder, in any case where none has the name as it stands. Raises FileNotFoundError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        near = [f.getPath() for f in fs.listStatus(path.getParent()) if f.getPath().getName().lower() == path.getName().lower()] if fs.exists(path.getParent()) else []
        if not near:
            raise FileNotFoundError(f"{by} names {name}, which isn't there")
        path = near[0]
    return path


def include_paths(spark: SparkSession, master: str) -> list[str]:
    """The master file and the files that it redirects to, one level deep, in order.

    A name is taken from the master's folder and may lead to others; it is matched to a file in any case where none has it as it stands. Raises FileNotFoundError for a file that isn't there.
    """
    text = located_lines(spark, _literal(master))
    named = text.select("pos", found(F.trim("line"), r"(?i)^redirect\s+[\"(]?([^!\")]+)").alias("name")).filter("name IS NOT NULL")
    wanted = [r["name"].strip().replace("\\", "/") for r in named.orderBy("pos").collect()]  # a row for each include statement
    folder = spark._jvm.org.apache.hadoop.fs.Path(master).getParent()
    return [master, *(_found_file(spark, folder, name, master).toString() for name in wanted)]


def script(spark: SparkSession, master: str) -> DataFrame:
    """file_ord (0), pos, line of a script with all that it includes, at any depth, where it includes it, and without what stands before its last Clear.

    Names are taken from the folder of the file that they stand in; after a Compile, but not after a Redirect, from the folder that the compiled file leaves behind. Files of one depth are read at once, and
    each file once; the driver sees a row for each include statement. A file that includes itself raises ValueError, one that isn't there FileNotFoundError. Lines are ordered by the places of the
    statements that lead to them and their own.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    top = path_of(master)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top)
    # files by their qualified names: path, includes (pos, verb, path)
    files, level = {top.toString(): top}, [top]
    includes: dict[str, list[tuple[int, str, str]]] = {}
    left: dict[str, object] = {}  # where a file leaves the folder

    def stated(paths: list) -> dict[str, list[tuple[int, str, str]]]:
        tails = {t: p.toString() for p in paths for t in (_tail(p.toString()), _tail(p.toUri().toString()))}
        rows = located_lines(spark, [_literal(p.toString()) for p in paths])
        line = F.trim("line")
        rows = rows.select("file", "pos", F.lower(found(line, _INCLUDE)).alias("verb"), F.trim(found(line, _INCLUDE, 2)).alias("name")).filter("name IS NOT NULL").collect()
        out: dict[str, list[tuple[int, str, str]]] = {p.toString(): [] for p in paths}
        for r in rows:
            out[tails[_tail(r["file"])]].append((r["pos"], r["verb"], r["name"].replace("\\", "/")))
        return {k: sorted(v) for k, v in out.items()}

    told: dict[str, list[tuple[int, str, str]]] = {}

    def walked(name: str, above: tuple[str, ...]) -> bool:
        """Resolve a file's includes in turn; False where a file that it needs is not read yet."""
        if name in left:
            return True
        if name in above:
            raise ValueError(f"{name} includes itself")
        if name not in told:
            return False
        folder, own = files[name].getParent(), []
        for pos, verb, wanted in told[name]:
            path = _found_file(spark, folder, wanted, name)
            path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
            key = path.toString()
            files.setdefault(key, path)
            if not walked(key, (*above, name)) and verb == "compile":
                return False
            own.append((pos, verb, key))
            folder = left[key] if verb == "compile" else folder
        if all(k in left for _, _, k in own):
            includes[name], left[name] = own, folder
        return name in left

    while level:
        told |= stated(level)
        walked(top.toString(), ())
        level = [p for k, p in files.items() if k not in told]
    shown: list[tuple[list[int], str]] = []
    stack: list[tuple[tuple[int, ...], str]] = [((), top.toString())]
    while stack:
        at, name = stack.pop()
        shown += [(list(at), t) for t in {_tail(name), _tail(files[name].toUri().toString())}]
        stack += [((*at, pos), key) for pos, _, key in includes[name]]
    text = located_lines(spark, [_literal(k) for k in files]).withColumn("file", F.regexp_replace("file", "^[^:/]+:/*", "/"))
    placed = text.join(spark.createDataFrame(shown, "above array<bigint>, file string"), "file").select(F.concat("above", F.array("pos")).alias("key"), "line")
    cleared = F.broadcast(placed.filter(F.trim("line").rlike(r"(?i)^clear\b")).agg(F.max("key").alias("_cleared")))  # one row
    kept = placed.crossJoin(cleared).filter(F.col("_cleared").isNull() | (F.col("key") > F.col("_cleared"))).drop("_cleared")
    return numbered(kept, "key", name="pos").select(F.lit(0).alias("file_ord"), "pos", "line")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_ord, pos, line of text files, in the order given; a file that is given twice comes twice. Names may hold any characters.

    A file is read in as many parts as Spark splits it into; a line's number is its place in its part and the lines of the parts before, of which there is a row for each part.
    """
    known = set()
    for k, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
        known |= {(k, _tail(whole.toString())), (k, _tail(whole.toUri().toString()))}  # Spark names a file as it stands or as a URI
    names = spark.createDataFrame(sorted(known), "file_ord int, file string")
    text = located_lines(spark, [_literal(p) for p in sorted(set(paths))]).withColumn("file", F.regexp_replace("file", "^[^:/]+:/*", "/"))
    return text.join(F.broadcast(names), "file").select("file_ord", "pos", "line")  # a row or two for each name in `paths`


def located_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, pos (from 0), line of text files of any size."""
    at = ["file", "block"]
    scan = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    parts = scan.groupBy(*at).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")  # a row for each part of a file
    bases = parts.select(*at, (before - F.col("first")).alias("base"))
    return scan.join(bases, at).select("file", (F.col("id") + F.col("base")).alias("pos"), "line")


def _tail(path: str) -> str:
    """A path without its scheme and what leading slashes it brings."""
    return re.sub("^[^:/]+:/*", "/", path)


def _literal(path: str) -> str:
    """A path whose characters are no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


#: Lines in a block, which is what meets in one place.
BLOCK_LINES = 8192


def merged(rows: DataFrame, by: str, pos: str, text: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """by, pos, cmd, n_lines: lines that begin with ~ joined to the command directly above; blank and comment lines (!) end it.

    A ~ line without a command above begins one of its own, which matches no kind. Lines meet in blocks of `block_lines` by their place; lines of a block that go on with a command of the block
    above, and the last command of each block, are joined in a second step, in which there are two rows for each block.
    """
    line = F.trim(F.col(text))
    block = F.floor(F.col(pos) / block_lines).cast("long")
    w = W.partitionBy(by, "_block").orderBy(pos)
    out = rows.select(by, pos, line.alias("line"), block.alias("_block")).withColumn("skip", (F.col("line") == "") | F.col("line").startswith("!"))
    # a ~ line that a block begins with heads nothing for now, and has the number 0
    head = ~F.col("line").startswith("~") | F.coalesce(F.lag("skip").over(w), F.lit(False))
    out = out.withColumn("_command", F.sum((head & ~F.col("skip")).cast("int")).over(w))
    out = out.withColumn("_last", F.max("_command").over(W.partitionBy(by, "_block")) == F.col("_command"))
    said = F.when(~F.col("skip"), F.struct(F.col(pos).alias("p"), F.regexp_replace("line", r"^~\s*", "").alias("t")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), " ")
    made = out.groupBy(by, "_block", "_command", "_last").agg(F.min(F.when(~F.col("skip"), F.col(pos))).alias(pos), parts.alias("cmd"), F.count_if(~F.col("skip")).alias("n_lines"), F.max_by(~F.col("skip"), pos).alias("_open"))
    on_border = F.col("_last") | (F.col("_command") == 0)
    edge = W.partitionBy(by).orderBy("_block", "_command")  # two rows for each block
    goes_on = (F.col("_command") == 0) & (F.col("n_lines") > 0) & F.coalesce(F.lag("_open").over(edge), F.lit(False))
    border = made.filter(on_border).withColumn("_first", ~goes_on).withColumn("_island", F.sum(F.col("_first").cast("int")).over(edge))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("n_lines") > 0, F.struct("_block", "_command", "cmd")))), lambda x: x["cmd"])
    joined = border.groupBy(by, "_island").agg(F.min(pos).alias(pos), F.array_join(pieces, " ").alias("cmd"), F.sum("n_lines").alias("n_lines"))
    return made.filter(~on_border).select(by, pos, "cmd", "n_lines").unionByName(joined.filter("n_lines > 0").select(by, pos, "cmd", "n_lines"))


def statements(text: DataFrame) -> DataFrame:
    """file_ord, pos, cmd, n_lines, kind, name from lines."""
    out = merged(text, "file_ord", "pos", "line")
    return out.withColumn("kind", kind(F.col("cmd"))).withColumn("name", object_name(F.col("cmd")))


def like_resolved(rows: DataFrame, key: str, like: str, columns: list[str], most_rounds: int = 40) -> DataFrame:
    """Columns that a row lacks, taken from the row that it is `like`, or from what that is like, and so on, in any case.

    Ways double in length each round, so a chain of n takes about log2(n) joins. Of rows with one name the greatest counts as a base. A name that nothing has ends a chain. Raises ValueError where rows are like each other in a circle.
    """
    own = rows.filter(F.col(key).isNotNull()).groupBy(F.lower(F.col(key)).alias("_key")).agg(F.max(F.struct(F.lower(F.col(like)).alias("up"), *columns)).alias("b"))
    state = staged(own.select("_key", F.col("b.up").alias("_up"), *[F.col(f"b.{c}").alias(f"_{c}") for c in columns]))
    for _ in range(most_rounds):
        if state.filter("_up IS NOT NULL").isEmpty():
            out = rows.join(state, F.lower(F.col(like)) == F.col("_key"), "left")
            return out.select(*[c for c in rows.columns if c not in columns], *[F.coalesce(c, f"_{c}").alias(c) for c in columns])
        base = state.select(F.col("_key").alias("_k"), F.col("_up").alias("_far"), *[F.col(f"_{c}").alias(f"_base_{c}") for c in columns])
        state = staged(state.join(base, F.col("_up") == F.col("_k"), "left").select("_key", F.col("_far").alias("_up"), *[F.coalesce(f"_{c}", f"_base_{c}").alias(f"_{c}") for c in columns]))
    raise ValueError("rows are like each other in a circle")


def of_kind(stmts: DataFrame, name: str) -> DataFrame:
    return stmts.filter(F.col("kind") == name)


def source(stmts: DataFrame) -> DataFrame:
    cmd = F.col("cmd")
    return of_kind(stmts, "circuit").select(found(cmd, r"(?i)circuit\.(\S+)").alias("name"), number(cmd, "basekv").alias("base_kv"), prop(cmd, "bus1").alias("bus"))


def _wired(stmts: DataFrame, name: str, phases: Column, linecode: Column) -> DataFrame:
    """Sections with both ends and a length; others are no sections."""
    cmd = F.col("cmd")
    rows = of_kind(stmts, name).select("file_ord", "pos", "name", phases.cast("int").alias("phases"), prop(cmd, "bus1").alias("bus1"), prop(cmd, "bus2").alias("bus2"), number(cmd, "length").alias("length"), linecode.alias("linecode"))
    return rows.filter("phases IS NOT NULL AND bus1 IS NOT NULL AND bus2 IS NOT NULL AND length IS NOT NULL")


def switches(stmts: DataFrame) -> DataFrame:
    """The switches, and whether they are closed: not if the last statement that opens or closes one opens it."""
    rows = _wired(stmts, "switch", number(F.col("cmd"), "phases"), F.lit(None).cast("string"))
    return _with_state(rows, stmts)


def line_sections(stmts: DataFrame) -> DataFrame:
    cmd = F.col("cmd")
    return _wired(stmts, "line", F.coalesce(number(cmd, "phases"), F.lit(3)), prop(cmd, "linecode"))


def states(stmts: DataFrame) -> DataFrame:
    """element (class.name in lower case), closed: by the last statement that opens or closes it."""
    moved = stmts.filter(F.col("kind").isin("open", "close")).select("file_ord", "pos", F.lower(found(F.col("cmd"), r"(?i)^(?:open|close)\s+(\w+\.\S+)")).alias("element"), (F.col("kind") == "close").alias("closed"))
    return moved.groupBy("element").agg(F.max_by("closed", F.struct("file_ord", "pos")).alias("closed"))


def _with_state(rows: DataFrame, stmts: DataFrame) -> DataFrame:
    now = states(stmts).withColumnRenamed("closed", "_closed")
    out = rows.join(now, F.concat(F.lit("line."), F.lower("name")) == F.col("element"), "left")
    return out.select(*rows.columns, F.coalesce("_closed", F.lit(True)).alias("closed"))


def transformers(stmts: DataFrame) -> DataFrame:
    """Windings' buses and ratings; kva=[a b], kvas=[a b] and repeated kva=a count alike."""
    cmd = F.col("cmd")
    listed = F.split(F.trim(found(cmd, r"(?i)\bbuses\s*=\s*[\[(]([^\])]*)")), r"[\s,]+")
    kva = F.flatten(F.transform(F.regexp_extract_all(cmd, F.lit(r"(?i)\bkvas?\s*=\s*[\[(]?([\d.\s,]+)"), F.lit(1)), lambda x: F.split(F.trim(x), r"[\s,]+")))
    return of_kind(stmts, "transformer").select("file_ord", "pos", "name", F.coalesce(listed, F.array().cast("array<string>")).alias("buses"), F.filter(F.transform(kva, lambda x: x.try_cast("double")), lambda x: x.isNotNull()).alias("kva"))


def capacitors(stmts: DataFrame) -> DataFrame:
    cmd = F.col("cmd")
    rows = of_kind(stmts, "capacitor").select("name", prop(cmd, "bus1").alias("bus"), number(cmd, "kvar").alias("kvar"), number(cmd, "kv").alias("kv"))
    return rows.filter("bus IS NOT NULL AND kvar IS NOT NULL AND kv IS NOT NULL")


def regulators(stmts: DataFrame) -> DataFrame:
    cmd = F.col("cmd")
    rows = of_kind(stmts, "regcontrol").select("name", prop(cmd, "like").alias("like"), prop(cmd, "transformer").alias("transformer"), number(cmd, "winding").cast("int").alias("winding"))
    return like_resolved(rows, "name", "like", ["transformer", "winding"]).drop("like").filter("transformer IS NOT NULL AND winding IS NOT NULL")


def _loads(stmts: DataFrame) -> DataFrame:
    cmd = F.col("cmd")
    rows = of_kind(stmts, "load").select("file_ord", "pos", "name", prop(cmd, "bus1").alias("bus_terminal"), number(cmd, "phases").cast("int").alias("phases"), prop(cmd, "conn").alias("connection"), number(cmd, "model").cast("int").alias("model"), number(cmd, "kv").alias("kv"), number(cmd, "kw").alias("base_kw"), number(cmd, "kvar").alias("base_kvar"))
    at = load_terminal(F.col("bus_terminal"), F.col("phases"))
    return rows.filter(_complete()).select("file_ord", "pos", "name", at["bus"].alias("bus"), "bus_terminal", at["phase"].alias("phase"), "phases", "connection", "model", "kv", "base_kw", "base_kvar")


def loads(stmts: DataFrame) -> DataFrame:
    """The loads with load_seq, their number from 0 in the order of buses and, at one bus, of the text; statements that lack a field are left to `rejects`."""
    return numbered(_loads(stmts), "bus", "file_ord", "pos", name="load_seq")


def _complete() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("bus_terminal", "phases", "connection", "model", "kv", "base_kw", "base_kvar")])


def rejects(stmts: DataFrame) -> DataFrame:
    """Load statements that `loads` leaves out."""
    return of_kind(stmts, "load").join(_loads(stmts).select("file_ord", "pos"), ["file_ord", "pos"], "left_anti")


def generators(stmts: DataFrame) -> DataFrame:
    """Generators and storage units: name, device, bus, kv, kw (rated), pf, duty (the name of their shape)."""
    cmd = F.col("cmd")
    rows = stmts.filter(F.col("kind").isin("generator", "storage"))
    return rows.select("name", F.col("kind").alias("device"), prop(cmd, "bus1").alias("bus"), number(cmd, "kv").alias("kv"), F.coalesce(number(cmd, "kw"), number(cmd, "kwrated")).alias("kw"), F.coalesce(number(cmd, "pf"), F.lit(1.0)).alias("pf"), prop(cmd, "duty").alias("duty"))


def shapes(stmts: DataFrame) -> DataFrame:
    """Load shapes: name, npts, interval_s (from sinterval, or Interval in hours, which may be postfix arithmetic), file."""
    cmd = F.col("cmd")
    hours = F.coalesce(rpn(found(cmd, r"(?i)\binterval\s*=\s*\(([^)]*)\)")), number(cmd, "interval"))
    return of_kind(stmts, "loadshape").select("name", number(cmd, "npts").cast("int").alias("npts"), F.coalesce(number(cmd, "sinterval"), hours * 3600).alias("interval_s"), found(cmd, r"(?i)\bfile\s*=\s*([^\s)]+)").alias("file"))


def monitors(stmts: DataFrame) -> DataFrame:
    """Monitors: name, element, terminal, mode."""
    cmd = F.col("cmd")
    return of_kind(stmts, "monitor").select("name", F.coalesce(prop(cmd, "element"), found(cmd, r"(?i)^new\s+monitor\.\S+\s+([\w.]+)")).alias("element"), F.coalesce(number(cmd, "terminal"), F.lit(1)).cast("int").alias("terminal"), F.coalesce(number(cmd, "mode"), F.lit(0)).cast("int").alias("mode"))


def solves(stmts: DataFrame) -> DataFrame:
    """file_ord, pos, mode, n (steps), step_s of every run; without a mode a snapshot of one step."""
    cmd = F.col("cmd")
    unit = F.lower(found(cmd, r"(?i)\bstepsize\s*=\s*[\d.]+([smh])"))
    step = number(cmd, "stepsize") * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return of_kind(stmts, "solve").select("file_ord", "pos", F.lower(F.coalesce(prop(cmd, "mode"), F.lit("snapshot"))).alias("mode"), F.coalesce(number(cmd, "number"), F.lit(1)).cast("int").alias("n"), F.coalesce(step, F.lit(1)).cast("double").alias("step_s"))


def edits(stmts: DataFrame) -> DataFrame:
    """file_ord, pos, class, name, prop, value of statements such as Class.name.prop=value, class, name and prop in lower case."""
    cmd = F.col("cmd")
    rows = of_kind(stmts, "edit").select("file_ord", "pos", F.lower(found(cmd, r"^(\w+)\.")).alias("class"), F.lower(found(cmd, r"^\w+\.([^.\s]+)\.")).alias("name"), F.explode(assignments(F.regexp_replace(cmd, "!.*$", ""))).alias("a"))
    return rows.select("file_ord", "pos", "class", "name", "a.prop", "a.value")


def bulk_edits(stmts: DataFrame) -> DataFrame:
    """file_ord, pos, class, pattern, prop, value of statements such as batchedit class.pattern prop=value."""
    cmd = F.col("cmd")
    rows = of_kind(stmts, "batchedit").select("file_ord", "pos", F.lower(found(cmd, r"(?i)^batchedit\s+(\w+)\.")).alias("class"), found(cmd, r"(?i)^batchedit\s+\w+\.(\S+)").alias("pattern"), F.explode(assignments(F.regexp_replace(cmd, "!.*$", ""))).alias("a"))
    return rows.select("file_ord", "pos", "class", "pattern", "a.prop", "a.value")


#: Parts that names and rules of bulk edits are dealt into beside their letters, and letters of a pattern that they are dealt by.
SALTS, LETTERS = 16, 8


def bulk_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """names (name) with each of rules (pattern, and what else it has) whose pattern a whole name matches, in any case.

    A pattern that begins or ends in plain letters can only match names that do: rules are filed by these letters, names look under all that they begin and end with, and only what meets there is matched. A pattern without either
    is tried on all names, which its meaning demands.
    """
    pattern = F.col("pattern")
    plain = F.regexp_extract(pattern, r"^[A-Za-z0-9_-]*", 0)
    repeated = F.regexp_extract(pattern, r"^[A-Za-z0-9_-]*([*?+{]?)", 1) != ""  # what is repeated may be absent
    begin = F.when(pattern.contains("|"), "").when(repeated, F.left(plain, F.length(plain) - 1)).otherwise(plain)
    end = F.when(pattern.contains("|") | pattern.contains("\\"), "").otherwise(F.regexp_extract(pattern, r"[A-Za-z0-9_-]*$", 0))
    filed = F.when(begin != "", F.concat(F.lit("<"), F.lower(F.left(begin, F.lit(LETTERS))))).when(end != "", F.concat(F.lit(">"), F.lower(F.right(end, F.lit(LETTERS))))).otherwise("")
    rules = rules.withColumn("_filed", filed).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    low = F.lower("name")
    heads = F.transform(F.sequence(F.lit(1), F.lit(LETTERS)), lambda n: F.concat(F.lit("<"), F.left(low, n)))
    tails = F.transform(F.sequence(F.lit(1), F.lit(LETTERS)), lambda n: F.concat(F.lit(">"), F.right(low, n)))
    looked = names.withColumn("_filed", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), heads, tails)))).withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    whole = F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")$"))
    return looked.join(rules, ["_filed", "_salt"]).filter(F.regexp_like("name", whole)).drop("_filed", "_salt")


def versions(names: DataFrame, stmts: DataFrame, of: str, prop_name: str) -> DataFrame:
    """file_ord, pos, name (lower case), value: what edits and bulk edits of class `of` set a property of names (name) to, each from its place in the text on."""
    at = ["file_ord", "pos"]
    own = edits(stmts).filter((F.col("class") == of) & (F.col("prop") == prop_name)).select(*at, "name", "value")
    rules = bulk_edits(stmts).filter((F.col("class") == of) & (F.col("prop") == prop_name)).select(*at, "pattern", "value")
    known = names.select(F.lower("name").alias("name")).distinct()
    return own.unionByName(bulk_hits(known, rules).select(*at, "name", "value"))


def edited(rows: DataFrame, stmts: DataFrame, of: str, prop_name: str, column: str) -> DataFrame:
    """rows (name) with a column as edits and bulk edits of class `of` leave it, the last one in the text winning; null where none touches it, unless rows have the column."""
    last = versions(rows, stmts, of, prop_name).groupBy(F.col("name").alias("_name")).agg(F.max(F.struct("file_ord", "pos", "value"))["value"].alias("_value"))
    new = F.col("_value").try_cast(rows.schema[column].dataType) if column in rows.columns else F.col("_value")
    kept = F.coalesce(new, F.col(column)) if column in rows.columns else new
    return rows.join(last, F.lower("name") == F.col("_name"), "left").withColumn(column, kept).drop("_name", "_value")


def runs(stmts: DataFrame) -> DataFrame:
    """run (from 0, in the order of the text) and what `solves` has of it."""
    return numbered(solves(stmts), "file_ord", "pos", name="run")


def at_runs(names: DataFrame, stmts: DataFrame, of: str, prop_name: str) -> DataFrame:
    """run, name (lower case), value: a property of names (name) as it stands at each run of the text, after the edits before it and none of those behind; no row where nothing set it yet.

    A running count of runs tells how many stand before each edit. Of an object's edits between two runs the last holds, from there to the run before its next.
    """
    at = ["file_ord", "pos"]
    made = versions(names, stmts, of, prop_name).select(*at, "name", "value", F.lit(0).alias("mark"))
    marks = of_kind(stmts, "solve").select(*at, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("mark"))
    counted = running(made.unionByName(marks), "mark", *at, "mark", "name", name="since")
    n = marks.agg(F.count("*").alias("_runs"))
    last = counted.filter("mark = 0").groupBy("name", "since").agg(F.max_by("value", F.struct(*at)).alias("value"))
    until = F.lead("since").over(W.partitionBy("name").orderBy("since"))  # a row for each run at most
    held = last.withColumn("until", until).crossJoin(F.broadcast(n)).filter("since < _runs")  # one row
    return held.select(F.explode(F.sequence("since", F.coalesce("until", "_runs") - 1)).alias("run"), "name", "value")


def line_codes(stmts: DataFrame) -> DataFrame:
    """name, i, j, r, x, c: the lower triangles of the matrices of line codes; rows are parted by |, brackets are square or round."""
    cmd = F.col("cmd")

    def cells(matrix: str) -> Column:
        rows = F.split(found(cmd, rf"(?i)\b{matrix}\s*=\s*[\[(]([^\])]*)"), r"\|")
        return F.flatten(F.transform(rows, lambda row, i: F.transform(F.split(F.trim(row), r"[\s,]+"), lambda v, j: F.struct((i + 1).alias("i"), (j + 1).alias("j"), v.try_cast("double").alias("v")))))

    at = lambda m, cell: F.element_at(F.filter(m, lambda y: (y["i"] == cell["i"]) & (y["j"] == cell["j"])), 1)["v"]
    made = of_kind(stmts, "linecode").select("name", *[cells(f"{m}matrix").alias(m) for m in "rxc"])
    made = made.withColumns({m: F.coalesce(m, F.array().cast("array<struct<i:int,j:int,v:double>>")) for m in "xc"})
    made = made.select("name", F.explode(F.transform("r", lambda q: F.struct(q["i"].alias("i"), q["j"].alias("j"), q["v"].alias("r"), F.when(F.size("x") > 0, at(F.col("x"), q)).alias("x"), F.when(F.size("c") > 0, at(F.col("c"), q)).alias("c")))).alias("m"))
    return made.select("name", "m.*")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """bus, x, y from lines of three fields parted by white space or commas."""
    part = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(part[0].alias("bus"), part[1].try_cast("double").alias("x"), part[2].try_cast("double").alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL")


def load_shape(spark: SparkSession, path: str, interval_s: float) -> DataFrame:
    """step, t_s, mult from a file of any size with one multiplier a line; blank lines don't count."""
    rows = numbered(located_lines(spark, path).filter(F.trim("line") != ""), "file", "pos", by=("file",), name="step")
    return rows.select("step", (F.col("step") * interval_s).alias("t_s"), F.trim("line").try_cast("double").alias("mult"))


def edges(stmts: DataFrame) -> DataFrame:
    """file_ord, pos, id, src, dst, device, phases, length, linecode of closed switches, two-bus transformers and closed lines; terminals without their phases."""
    bare = lambda c: F.split(F.col(c), r"\.")[0]
    wired = [rows.select("file_ord", "pos", F.col("name").alias("id"), bare("bus1").alias("src"), bare("bus2").alias("dst"), F.lit(device).alias("device"), "phases", "length", "linecode") for device, rows in (("switch", switches(stmts).filter("closed")), ("line", _with_state(line_sections(stmts), stmts).filter("closed")))]
    paired = transformers(stmts).filter(F.size("buses") == 2).select("file_ord", "pos", F.col("name").alias("id"), F.split(F.col("buses")[0], r"\.")[0].alias("src"), F.split(F.col("buses")[1], r"\.")[0].alias("dst"), F.lit("transformer").alias("device"), F.lit(1).alias("phases"), F.lit(0.0).alias("length"), F.lit(None).cast("string").alias("linecode"))
    return reduce(DataFrame.unionByName, [*wired, paired])


def nodes(stmts: DataFrame) -> DataFrame:
    """id, base_bus, kind, phases of every terminal named; phases are those of the last mention, phases_union those of all."""
    two = [rows.select("file_ord", "pos", F.explode(F.array("bus1", "bus2")).alias("terminal")) for rows in (switches(stmts), line_sections(stmts))]
    rest = [transformers(stmts).select("file_ord", "pos", F.explode("buses").alias("terminal")), of_kind(stmts, "capacitor").select("file_ord", "pos", prop(F.col("cmd"), "bus1").alias("terminal"))]
    seen = reduce(DataFrame.unionByName, [*two, *rest]).filter("terminal IS NOT NULL").withColumn("t", terminal(F.col("terminal")))
    last = F.max_by("t", F.struct("file_ord", "pos", "terminal"))
    out = seen.groupBy(F.col("t.id").alias("id")).agg(last.alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("t.phases")))).alias("phases_union"))
    return out.select("id", "t.base_bus", "t.kind", "t.phases", "phases_union")


def in_order(node_table: DataFrame) -> DataFrame:
    return node_table.orderBy(F.coalesce("base_bus", F.lit(9999)), "id")
