"""Queries over readings: barriers, alignment, lookups, and the same through streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import series
from gridloom.operators.order import numbered
from gridloom.plans import adapters as A
from gridloom.plans.registry import query
from gridloom.sources import documents as D
from gridloom.sources.shared import shared_dir, staged
from gridloom.streaming import barrier, clock

METERS = 5
_LAST = "last AS (SELECT date_trunc('{0}', ts) AS tick, event_type AS meter, max_by(value, (ts, event_id)) AS p_kw FROM events GROUP BY 1, 2)"
_FULL = "SELECT CAST(tick AS TIMESTAMP) AS tick, count(*) AS n_meters, round(sum(p_kw), 6) AS p_kw FROM last GROUP BY 1 HAVING count(*) >= 5"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tick").agg(F.count("*").alias("n_meters"), F.round(F.sum("p_kw"), 6).alias("p_kw"))


@query(f"WITH {_LAST.format('day')} {_FULL}")
def tick_barrier_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day ticks for which all five meters have reported, with each meter's last reading."""
    return _totals(series.barrier(A.readings(spark, sf_dir), "tick", "meter", ["ts", "event_id"], ["p_kw"], METERS))


@query(f"WITH {_LAST.format('hour')} {_FULL}")
def hourly_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the hour, where many ticks stay incomplete."""
    return _totals(series.barrier(A.readings(spark, sf_dir, "hour"), "tick", "meter", ["ts", "event_id"], ["p_kw"], METERS))


#: Rows of a file that is streamed, and files of a batch at most.
FILE_ROWS = 100_000
BATCH_FILES = 32


def _by_size(rows: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """rows in files of about FILE_ROWS each, a few at least, dealt by keys or without order."""
    return rows.repartition(max(least, rows.count() // FILE_ROWS), *keys)


def _at_once(n: int, batches: int, least: int = 1) -> int:
    """Of n rows in files of FILE_ROWS, how many of these a batch takes: as a batch costs a second or two whatever it holds, their number shall not grow with the table before they are large."""
    return max(least, min(BATCH_FILES, n // FILE_ROWS // batches))


def _as_files(rows: DataFrame, files: int) -> str:
    """rows as files to be streamed, so many at least, dealt out without order."""
    path = f"{shared_dir(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    _by_size(rows, least=files).write.json(path)
    return path


def _streamed(stream: DataFrame, kind: str = "parquet") -> DataFrame:
    """What a stream gives until its source is used up."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    barrier.appended(stream, path, f"{path}-checkpoint", kind).awaitTermination()
    return spark.read.schema(stream.schema).format(kind).option("header", True).load(path)


def _events_in_batches(spark: SparkSession, sf_dir: str, files: int) -> tuple[DataFrame, str]:
    """A stream of all events, in so many batches or more and in no order of time, and after them a reading of no meter, years later, which ends all ticks. And how late a reading may come: 400 days, or the events' whole span if that is more."""
    rows = A.readings(spark, sf_dir).select(F.col("tick").cast("timestamp").alias("tick"), "meter", F.col("ts").cast("timestamp").alias("ts"), "event_id", "p_kw")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _by_size(rows, least=files).write.parquet(path)
    n, days = rows.agg(F.count("*"), F.coalesce(F.datediff(F.max("ts"), F.min("ts")), F.lit(0))).first()
    late = max(400, days + 2)
    end = rows.agg(F.max("ts").alias("ts")).select(F.expr(f"ts + INTERVAL 9 YEARS + INTERVAL {late} DAYS"))
    end.select(F.date_trunc("day", end[0]).alias("tick"), F.lit("none").alias("meter"), end[0].alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("p_kw")).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _at_once(n, files)).parquet(path), f"{late} days"


@query("""
WITH wm AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM events WHERE event_type <> 'view'), kept AS (SELECT e.*, date_trunc('day', ts) AS tick FROM events e, wm WHERE event_type <> 'view' OR ts > wm.t),
last AS (SELECT tick, event_type AS meter, max_by(value, (ts, event_id)) AS p_kw FROM kept GROUP BY 1, 2)
SELECT CAST(tick AS TIMESTAMP) AS tick, count(*) AS n_meters, count(*) >= 5 AS complete, round(sum(p_kw), 6) AS p_kw FROM last GROUP BY tick""")
def late_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as told at their end when one kind of meter comes late: its readings from before the watermark, a day behind the latest of the others, are dropped, and days that lack it are told incomplete."""
    rows = A.readings(spark, sf_dir).select("tick", "meter", "ts", "event_id", "p_kw").withColumns({c: F.col(c).cast("timestamp") for c in ("tick", "ts")})
    path, out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    rows.limit(0).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path).withWatermark("ts", "1 day")
    stream = stream.withColumns({"at": F.unix_micros("ts"), "end": F.col("tick") + F.expr("INTERVAL 1 DAY")})
    told = barrier.closed(stream, "tick", "meter", ["at", "event_id"], ["p_kw"], METERS, "end")
    late = F.col("meter") == "view"
    end = rows.agg(F.max("ts").alias("ts")).select(F.date_trunc("day", F.col("ts") + F.expr("INTERVAL 9 YEARS")).alias("tick"), F.lit("none").alias("meter"), (F.col("ts") + F.expr("INTERVAL 9 YEARS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("p_kw"))
    for part in (rows.filter(~late), rows.filter(late), end):
        part.write.mode("append").parquet(path)
        barrier.appended(told, out, f"{out}-checkpoint").awaitTermination()  # a batch each
    made = spark.read.schema(told.schema).parquet(out).filter("meter <> 'none'").withColumn("tick", F.col("tick").cast("timestamp_ntz"))
    return made.groupBy("tick").agg(F.count("*").alias("n_meters"), F.bool_and("complete").alias("complete"), F.round(F.sum("p_kw"), 6).alias("p_kw"))


@query(f"WITH {_LAST.format('day')} {_FULL}")
def tick_barrier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete day ticks through a stateful stream of the raw events, in many batches."""
    stream, late = _events_in_batches(spark, sf_dir, 6)
    stream = stream.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "end": F.col("tick") + F.expr("INTERVAL 1 DAY")})
    out = _streamed(barrier.closed(stream, "tick", "meter", ["at", "event_id"], ["p_kw"], METERS, "end")).filter("complete")
    return _totals(out.withColumn("tick", F.col("tick").cast("timestamp_ntz")))


@query(f"WITH {_LAST.format('day')} {_FULL}")
def tick_barrier_emitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete day ticks, each sent as soon as its last meter reports, from the raw events in many batches.

    Two kinds of meters come first, dealt out without order, so their days wait; then the others, each day of theirs in one file, which completes it. All readings are sent once more after that, with other values, and change nothing.
    Between these the stream ends and begins again where it was.
    """
    rows = A.readings(spark, sf_dir).select("tick", "meter", "ts", "event_id", "p_kw").withColumns({c: F.col(c).cast("timestamp") for c in ("tick", "ts")})
    rows = rows.withColumn("at", F.unix_micros("ts")).select("tick", "meter", "at", "event_id", "p_kw")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.limit(0).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _at_once(rows.count(), 3, least=2)).parquet(path)
    sent = barrier.assembled(stream, staged(rows.select("meter").distinct()), "tick", "meter", ["at", "event_id"], ["p_kw"])
    early, out = F.col("meter").isin("click", "error"), f"{path}-out"
    for part in (_by_size(rows.filter(early)), _by_size(rows.filter(~early), "tick"), _by_size(rows.withColumns({"at": F.col("at") + 1, "p_kw": F.lit(-1.0)}))):
        part.write.mode("append").parquet(path)
        barrier.appended(sent, out, f"{path}-checkpoint").awaitTermination()  # goes on where it ended
    return _totals(spark.read.schema(sent.schema).parquet(out).withColumn("tick", F.col("tick").cast("timestamp_ntz")))


@query(f"WITH {_LAST.format('hour')} SELECT CAST(tick AS TIMESTAMP) AS tick, count(*) AS n_meters FROM last GROUP BY 1 HAVING count(*) < 5")
def incomplete_ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that lack a meter, as the stream tells them at their end."""
    stream, late = _events_in_batches(spark, sf_dir, 3)
    stream = stream.withColumn("tick", F.date_trunc("hour", "ts")).withWatermark("ts", late).withColumn("end", F.col("tick") + F.expr("INTERVAL 1 HOUR"))
    out = _streamed(barrier.closed(stream, "tick", "meter", "event_id", ["p_kw"], METERS, "end")).filter("NOT complete")
    return out.withColumn("tick", F.col("tick").cast("timestamp_ntz")).groupBy("tick").agg(F.count("*").alias("n_meters"))


@query(f"WITH {_LAST.format('day')} SELECT CAST(tick AS TIMESTAMP) AS tick, meter, p_kw FROM last")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each meter and day through a stream in update mode, where every file is sent twice; the store keeps the last write."""
    rows = A.readings(spark, sf_dir).withColumn("tick", F.col("tick").cast("string")).withColumn("ts", F.col("ts").cast("string"))
    path = _as_files(rows.unionByName(rows), 4)
    stream = barrier.replayed(spark, path, "tick string, meter string, ts string, event_id long, p_kw double", 2)
    last = stream.groupBy("tick", "meter").agg(F.max_by(F.struct("ts", "event_id", "p_kw"), F.struct("ts", "event_id")).alias("v"))
    store = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    last.writeStream.outputMode("update").option("checkpointLocation", f"{store}-checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, k: batch.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{store}/b={k}")).start().awaitTermination()
    out = series.latest(spark.read.parquet(store), ["tick", "meter"], ["k"], ["v"])
    return out.select(F.col("tick").cast("timestamp_ntz").alias("tick"), "meter", "v.p_kw")


@query(f"WITH {_LAST.format('day')} SELECT CAST(tick AS TIMESTAMP) AS tick, count(*) AS n_meters, round(sum(p_kw), 6) AS total FROM last GROUP BY 1 HAVING count(*) >= 5")
def watermark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day totals by watermark and windows alone, from the raw events in many batches."""
    stream, late = _events_in_batches(spark, sf_dir, 4)
    out = _streamed(barrier.tick_totals(stream, "ts", "meter", "p_kw", "1 day", late, METERS, "event_id"))
    return out.select(F.col("tick").cast("timestamp_ntz").alias("tick"), "n_meters", F.round("total", 6).alias("total"))


@query(f"WITH {_LAST.format('hour')} SELECT CAST(tick AS TIMESTAMP) AS tick, count(*) AS n_meters FROM last GROUP BY 1 HAVING count(*) < 5")
def incomplete_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that wait for a meter."""
    return series.incomplete(A.readings(spark, sf_dir, "hour"), "tick", "meter", METERS)


@query("WITH s AS (SELECT c_name AS by_name, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS i FROM customer), c AS (SELECT c_name AS by_balance, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer) SELECT i, by_name, by_balance FROM s JOIN c USING (i)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th customer by name beside the i-th by balance."""
    rows = A.table(spark, sf_dir, "customer")
    left, right = rows.select(F.col("c_name").alias("by_name"), "c_custkey"), rows.select(F.col("c_name").alias("by_balance"), "c_acctbal", F.col("c_custkey").alias("key"))
    return series.zipped(left, ["by_name", "c_custkey"], right, ["c_acctbal", "key"]).select("i", "by_name", "by_balance")


@query("WITH t AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick FROM events), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY event_type)) SELECT event_type, event_id, value, tick FROM t, n WHERE tick < n")
def series_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's events numbered in time, as far as the shortest series goes."""
    rows = A.table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    return series.aligned(rows, "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value", "tick")


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN (SELECT s_suppkey, replace(s_name, 'Supplier', 'CUSTOMER') AS n FROM supplier) s ON lower(c.c_name) = lower(s.n)")
def ci_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that agree but for their case."""
    s = A.table(spark, sf_dir, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")).alias("n"))
    c = A.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("n"))
    return series.named_alike(c, s, "n").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in progress."""
    return series.unmatched(A.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers there are, and how many have an order."""
    c = A.table(spark, sf_dir, "customer").select("c_custkey")
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.agg(F.count("*").alias("n")).crossJoin(c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("matched")))  # one row each


@query("SELECT e.event_id, e.event_type AS meter, e.user_id AS bus, e.value AS p_kw, c.c_name AS load_name, round(c.c_acctbal, 2) AS bus_voltage FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def telemetry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings beside what was solved for their load."""
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("meter"), F.col("user_id").alias("bus"), F.col("value").alias("p_kw"))
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bus"), F.col("c_name").alias("load_name"), F.round("c_acctbal", 2).alias("bus_voltage"))
    return series.telemetry(e, c, "bus").select("event_id", "meter", "bus", "p_kw", "load_name", "bus_voltage")


@query("SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM part WHERE p_partkey >= 1) AS edges, (SELECT count(*) FROM customer) AS loads")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the model's tables."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return count(A.parents(spark, sf_dir), "nodes").crossJoin(count(A.tree_edges(spark, sf_dir), "edges")).crossJoin(count(A.loads(spark, sf_dir), "loads"))  # one row each


def _csv_round_trip(rows: DataFrame) -> DataFrame:
    from gridloom.sources.documents import append_csv

    path = f"{shared_dir(rows.sparkSession)}/csv-{uuid.uuid4().hex}"
    half = F.col("event_id") % 2 == 0
    append_csv(rows.filter(half), path)
    append_csv(rows.filter(~half), path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT event_id, event_type, value FROM events")
def csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to CSV files in two goes, read again."""
    return _csv_round_trip(staged(A.table(spark, sf_dir, "events").select("event_id", "event_type", "value")))


@query("SELECT CAST(t.i AS BIGINT) AS timestamp, event_type AS meter, event_id, value AS p_kw FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) t")
def replay_by_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type's events through a clock that deals their places, ended halfway and begun again from its checkpoint."""
    rows = numbered(A.table(spark, sf_dir, "events").select(F.col("event_type").alias("meter"), "ts", "event_id", F.col("value").alias("p_kw")), "ts", "event_id", by=("meter",), name="timestamp")
    rows = staged(rows.select("timestamp", "meter", "event_id", "p_kw"))
    last = (rows.agg(F.max("timestamp")).first()[0] or -1) + 1
    out, at_once = f"{shared_dir(spark)}/replayed-{uuid.uuid4().hex}", max(1, -(-last // 6))
    for end in (last // 2, last):
        stream = clock.replayed_ticks(spark, rows, at_once=at_once, last=end)
        run = barrier.appended(stream, out, f"{out}-checkpoint", now=False)
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return spark.read.schema(stream.schema).parquet(out)


_PROFILES_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick FROM events), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY event_type)),
m AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))
SELECT CAST(tick AS BIGINT) AS timestamp, 'event ' || event_id AS datetime, printf('M%03d', m.i) AS meter_id, 'load ' || event_type AS load_name, CAST(m.i AS BIGINT) AS bus, value AS p_kw, CAST(event_id % 100 AS DOUBLE) AS q_kvar, CAST(user_id AS DOUBLE) AS voltage, CAST(event_id AS DOUBLE) AS current
FROM t JOIN m USING (event_type) CROSS JOIN n WHERE tick < n.n"""


@query(_PROFILES_SQL)
def profile_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What meters send, from CSV profiles: each type's events are written as a household's folder of files, in order, and meters are paired with folders by place."""
    events = A.table(spark, sf_dir, "events")
    path = f"{shared_dir(spark)}/profiles-{uuid.uuid4().hex}"
    own = events.select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("datetime"), F.col("value").alias("Global_active_power"), (F.col("event_id") % 100).cast("double").alias("Global_reactive_power"), F.col("user_id").cast("double").alias("Voltage"), F.col("event_id").cast("double").alias("Global_intensity"), F.col("event_type").alias("synthetic"), "ts", "event_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.repartitionByRange(parts, "synthetic", "ts", "event_id").sortWithinPartitions("synthetic", "ts", "event_id").drop("ts", "event_id").write.partitionBy("synthetic").option("header", True).csv(path)
    types = numbered(events.select("event_type").distinct(), "event_type", name="i")
    meters = types.select(F.format_string("M%03d", F.col("i") + 1).alias("meter_id"), F.concat(F.lit("load "), "event_type").alias("load_name"), (F.col("i") + 1).alias("bus"))
    return D.messages(D.profiles(spark, f"{path}/synthetic=*", folders=True), meters)
