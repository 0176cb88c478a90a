"""Queries that parse text, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators.series import latest
from gridloom.plans.adapters import table
from gridloom.plans.registry import query
from gridloom.sources.statements import like_resolved, merged


@query(r"""
SELECT page_id, nullif(regexp_extract(url, '^https?://([^/:]+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang,
  nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS item, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page
FROM pages""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of a text, null where an optional one is missing."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.found(u, r"^https?://([^/:]+)").alias("host"), T.found(u, r"^https?://[^/]+/([a-z]{2})/").alias("lang"), T.found(u, r"/([0-9]+)(?:[?#]|$)").alias("item"), T.found(u, r"[?&]page=([0-9]+)").alias("page"))


@query(r"""
SELECT page_id, CAST(len(xs) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(xs, lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS total
FROM (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS xs FROM pages)""")
def extract_all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a pattern as an array, and their sum."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)).alias("xs"))
    return rows.select("page_id", F.size("xs").cast("long").alias("n"), F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


@query(r"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT CASE WHEN regexp_matches(line, '@[a-z]') THEN 'mail' WHEN regexp_matches(line, '[0-9]+\.[0-9]+\.[0-9]+') THEN 'address' WHEN line LIKE '%|%' THEN 'row'
  WHEN regexp_matches(line, '^[A-Z!. ,]+$') THEN 'shout' WHEN regexp_matches(line, '^\s*$') THEN 'blank' ELSE 'text' END AS kind, count(*) AS n
FROM lines GROUP BY 1""")
def stmt_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the first kind whose pattern matches."""
    line = F.col("line")
    kind = F.when(line.rlike("@[a-z]"), "mail").when(line.rlike(r"[0-9]+\.[0-9]+\.[0-9]+"), "address").when(line.contains("|"), "row").when(line.rlike("^[A-Z!. ,]+$"), "shout").when(line.rlike(r"^\s*$"), "blank").otherwise("text")
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_MARKED = "CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 3 = 0 THEN line ELSE '~ ' || line END"


@query(rf"""
WITH l AS (SELECT doc_id, pos - 1 AS pos, lines[pos] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
m AS (SELECT doc_id, pos, trim({_MARKED}, ' ') AS line FROM l),
s AS (SELECT *, line = '' OR starts_with(line, '!') AS skip FROM m),
h AS (SELECT *, NOT starts_with(line, '~') OR coalesce(lag(skip) OVER (PARTITION BY doc_id ORDER BY pos), true) AS head FROM s),
g AS (SELECT *, sum(CASE WHEN head AND NOT skip THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS command FROM h)
SELECT doc_id, CAST(min(pos) AS INT) AS pos, CAST(length(string_agg(regexp_replace(line, '^~\s*', ''), ' ' ORDER BY pos)) AS INT) AS n_chars, count(*) AS n_lines
FROM g WHERE NOT skip GROUP BY doc_id, command""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that continue a command joined to it. Two thirds of the lines are marked as continuations, every fifth is blank."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    out = merged(rows.withColumn("line", F.expr(_MARKED)), "doc_id", "pos", "line")
    return out.select("doc_id", "pos", F.length("cmd").alias("n_chars"), "n_lines")


_TERMINAL = "c_custkey || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'r' WHEN 2 THEN 's' ELSE '_OPEN' END || CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.2.3' ELSE '.1.2.3' END"


@query(rf"""
WITH t AS (SELECT c_custkey, {_TERMINAL} AS bus FROM customer)
SELECT c_custkey, string_split(bus, '.')[1] AS id, CAST(regexp_replace(string_split(bus, '.')[1], '[^0-9]', '', 'g') AS BIGINT) AS base_bus,
  CASE WHEN string_split(bus, '.')[1] LIKE '%\_OPEN' ESCAPE '\' THEN 'open_tie' WHEN string_split(bus, '.')[1] LIKE '%r' THEN 'regulator' WHEN string_split(bus, '.')[1] LIKE '%s' THEN 'switch' ELSE 'bus' END AS kind,
  array_to_string(list_transform(string_split(bus, '.')[2:], lambda p: CASE p WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' END), '') AS phases,
  CASE WHEN len(string_split(bus, '.')) = 4 THEN 'ABC' WHEN len(string_split(bus, '.')) = 1 THEN 'Unknown' ELSE array_to_string(list_transform(string_split(bus, '.')[2:], lambda p: CASE p WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' END), '') END AS phase
FROM t""")
def bus_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminals taken apart: base number, kind and phases."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TERMINAL.replace("c_custkey ||", "cast(c_custkey as string) ||", 1)).alias("bus"))
    rows = rows.withColumn("t", T.terminal(F.col("bus"))).withColumn("l", T.load_terminal(F.col("bus"), F.size(F.split("bus", r"\.")) - 1))
    return rows.select("c_custkey", "t.id", "t.base_bus", "t.kind", F.array_join("t.phases", "").alias("phases"), "l.phase")


@query(r"""
SELECT source, count(*) AS n_lines, CAST(sum(CASE WHEN regexp_matches(line, '^[^ ]+ [^ ]+ [^ ]+') THEN 0 ELSE 1 END) AS BIGINT) AS n_rejected
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def reject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a pattern doesn't match, counted by source."""
    rows = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("line").rlike("^[^ ]+ [^ ]+ [^ ]+")).alias("n_rejected"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON objects, by type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("SELECT event_id, to_json({'event_id': event_id, 'meter': event_type, 'p_kw': value}) AS value FROM events")
def message_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the JSON messages of a sink, and read back to the same."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("meter"), F.col("value").alias("p_kw"))).alias("value"))
    return rows.filter(F.from_json("value", "event_id long, meter string, p_kw double")["event_id"] == F.col("event_id"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    return latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""
WITH r AS (SELECT s_suppkey, 'S' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'S' || CAST(s_suppkey - s_suppkey % 3 AS VARCHAR) END AS base,
  CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_nationkey END AS winding, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE round(s_acctbal, 2) END AS vreg FROM supplier)
SELECT r.s_suppkey, r.name, coalesce(r.winding, b.winding) AS winding, coalesce(r.vreg, b.vreg) AS vreg FROM r LEFT JOIN r b ON lower(b.name) = lower(r.base)""")
def like_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that take what they lack from the row that they are like."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("S"), k.cast("string")).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("s"), (k - k % 3).cast("string"))).alias("base"), F.when(k % 3 != 1, F.col("s_nationkey")).alias("winding"), F.when(k % 3 != 2, F.round("s_acctbal", 2)).alias("vreg")
    )
    return like_resolved(rows, "name", "base", ["winding", "vreg"]).drop("base")


@query("SELECT p_partkey, round((0.00625 * p_size + 1) / 2, 9) AS value FROM part")
def rpn_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline arithmetic in postfix notation."""
    text = F.concat(F.lit("0.00625 "), F.col("p_size").cast("string"), F.lit(" * 1 + 2 /"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.rpn(text), 9).alias("value"))


@query("""
WITH e AS (SELECT vec_id, list_filter(embedding, lambda x, i: i % 2 = 1) AS xs FROM embeddings)
SELECT vec_id, CAST(len(xs) AS INT) AS n, round(list_sum(list_transform(xs, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(list_sum(list_transform(xs, lambda x: CAST(x AS DOUBLE))) / len(xs), 6) AS mean FROM e""")
def strided_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean of every second element."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", T.strided(F.transform("embedding", lambda x: x.cast("double")), 2).alias("xs"))
    return rows.select("vec_id", F.size("xs").alias("n"), F.round(T.total(F.col("xs")), 6).alias("total"), F.round(T.total(F.col("xs")) / F.size("xs"), 6).alias("mean"))


@query("SELECT c_custkey, c_name, c_nationkey, CAST(row_number() OVER (ORDER BY coalesce(nullif(c_nationkey, 7), 9999), c_name) - 1 AS BIGINT) AS place FROM customer")
def sort_null_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order in which nulls count as 9999; here nation 7 stands for null."""
    from gridloom.operators.order import numbered

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return numbered(rows, F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(7)), F.lit(9999)), "c_name", name="place")


@query("SELECT k, CAST(sum(a) AS INT) AS in_a, CAST(sum(b) AS INT) AS in_b FROM (SELECT DISTINCT c_nationkey AS k, 1 AS a, 0 AS b FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT s_nationkey, 0, 1 FROM supplier WHERE s_acctbal < 5000) GROUP BY k")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference and membership of two sets of keys, as flags."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("k")).distinct()
    both, only_a, only_b = a.join(b, "k", "left_semi"), a.join(b, "k", "left_anti"), b.subtract(a)
    flag = lambda rows, x, y: rows.select("k", F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    return flag(both, 1, 1).union(flag(only_a, 1, 0)).union(flag(only_b, 0, 1))
