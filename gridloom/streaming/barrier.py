"""Streams of meter messages: sources, a barrier that waits for complete ticks, sinks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

MESSAGE = "timestamp long, datetime string, meter_id string, load_name string, bus long, p_kw double, q_kvar double, voltage double, current double"


def replayed(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream over files of JSON messages, so many files in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def paced(spark: SparkSession, messages: DataFrame, per_second: int = 1, tick: str = "timestamp") -> DataFrame:
    """A stream of messages (tick: their number from 0) at so many ticks a second, from a clock; keep them in folders by tick for each to be read alone."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return clock.select(F.col("value").alias(tick)).join(messages, tick)


def from_kafka(spark: SparkSession, servers: str, topic: str, schema: str = MESSAGE) -> DataFrame:
    """A stream over a topic of JSON messages from its beginning. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def keyed_json(messages: DataFrame, key: str = "meter_id") -> DataFrame:
    """key, value as a broker takes them."""
    return messages.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return keyed_json(messages).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


#: Rows of a task that are looked through at once for those that later ones of their meter and tick outdo.
COMBINED_ROWS = 50_000


def _undone(rows: pa.Table, keys: list[str], order: list[str], event_time: str | None) -> pa.Table:
    """rows without those that another of the same keys outdoes, which is not before them by `order` nor, where that is given, by event time. Rows that lack one of these stay."""
    ints = [rows.column(c).cast(pa.int64()) for c in [*order, *([event_time] if event_time else [])]]
    lacking = np.zeros(len(rows), bool)
    for c in ints:
        lacking |= c.is_null().to_numpy()
    at = np.flatnonzero(~lacking)
    own = rows.take(pa.array(at))
    codes = [own.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in keys]
    ints = [c.take(pa.array(at)).to_numpy() for c in ints]
    placed = np.lexsort([*reversed(ints[: len(order)]), *reversed(codes)])[::-1]  # each key's last reading first; of equal ones the last that came
    first = np.ones(len(at), bool)
    first[1:] = np.any([c[placed][1:] != c[placed][:-1] for c in codes], axis=0)
    kept = first
    if event_time and len(at):
        rank = np.unique(ints[-1], return_inverse=True)[1][placed] + np.cumsum(first) * len(at)  # grows from key to key
        kept = first | np.append(True, rank[1:] > np.maximum.accumulate(rank)[:-1])
    return rows.take(pa.array(np.sort(np.append(at[placed[kept]], np.flatnonzero(lacking)))))


def combined(stream: DataFrame, keys: list[str], order: list[str], event_time: str | None = None) -> DataFrame:
    """The stream without readings that are outdone by others of their keys that the same task reads in the same batch, so that a shuffle takes few rows where a key has many.

    With an event time nothing is taken that could count once a watermark drops its betters: of two readings the one before by `order` (longs) goes only if its event time isn't after the other's, so the watermark stays as well.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts, n = [*parts, batch], n + batch.num_rows
            if n >= COMBINED_ROWS:
                rows = _undone(pa.Table.from_batches(parts), keys, order, event_time)
                parts, n = rows.to_batches(), len(rows)
                if n >= COMBINED_ROWS // 2:
                    yield from parts
                    parts, n = [], 0
        if n:
            yield from _undone(pa.Table.from_batches(parts), keys, order, event_time).to_batches()

    return stream.mapInArrow(kept, stream.schema)  # with the schema's mark of a watermark


def _rocksdb(spark: SparkSession) -> None:
    """The state store of the barriers, which writes what a batch changed and not all that it holds."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _lasts(part: pd.DataFrame, meter: str, order: list[str], values: list[str]) -> Iterator[tuple[str, tuple[Any, ...]]]:
    """Each meter of a part with the order and values of its last reading. In plain Python, as most parts are of a few rows."""
    best, n = {}, len(order)
    for name, *own in zip(*(part[c].tolist() for c in (meter, *order, *values)), strict=True):
        at = tuple(map(int, own[:n]))
        if name not in best or best[name][:n] <= at:
            best[name] = (*at, *(None if x is None or x != x else float(x) for x in own[n:]))  # not a number: null
    yield from best.items()


def _frame(tick: str, key: Any, meter: str, values: list[str], held: list[tuple[str, tuple[float | None, ...]]], more: dict[str, Any]) -> pd.DataFrame:
    """Rows of one tick: held has each meter's values."""
    own = {tick: [key] * len(held), meter: [k for k, _ in held]}
    return pd.DataFrame(own | {v: [x[i] for _, x in held] for i, v in enumerate(values)} | {k: [v] * len(held) for k, v in more.items()})


class _Barrier(StatefulProcessor):
    """The readings of one tick: a map of meters to their last one, and a mark once the tick was sent."""

    def __init__(self, tick: str, meter: str, order: list[str], values: list[str], expected: int, ttl_ms: int | None) -> None:
        self.tick, self.meter, self.order, self.values, self.expected, self.ttl_ms = tick, meter, order, values, expected, ttl_ms
        self.n = len(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "meter string", ", ".join([*(f"at{i} long" for i in range(self.n)), *(f"v{i} double" for i in range(len(self.values)))]), self.ttl_ms)
        self.sent = handle.getValueState("sent", "sent boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.sent.exists():
            return
        for part in rows:
            for name, own in _lasts(part, self.meter, self.order, self.values):
                before = self.held.getValue((name,)) if self.held.containsKey((name,)) else None
                if before is None or tuple(before)[: self.n] <= own[: self.n]:
                    self.held.updateValue((name,), own)
        if sum(1 for _ in self.held.keys()) >= self.expected:
            yield _frame(self.tick, key[0], self.meter, self.values, sorted((k[0], tuple(v)[self.n :]) for k, v in self.held.iterator()), {})
            self.held.clear()
            self.sent.update((True,))

    def close(self) -> None:
        pass


class _Closed(StatefulProcessor):
    """The last readings of one tick until its end: one list, which a batch with readings of the tick reads and writes once."""

    def __init__(self, tick: str, meter: str, order: list[str], values: list[str], expected: int, end: str) -> None:
        self.tick, self.meter, self.order, self.values, self.expected, self.end = tick, meter, order, values, expected, end
        self.n = len(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(["meter string", *(f"at{i} long" for i in range(self.n)), *(f"v{i} double" for i in range(len(self.values)))]))

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = {k: tuple(own) for k, *own in self.held.get()}
        new, changed = not held, False
        for part in rows:
            for name, own in _lasts(part, self.meter, self.order, self.values):
                if name not in held or held[name][: self.n] <= own[: self.n]:
                    held[name], changed = own, True
            if new and len(part):
                self.handle.registerTimer(int(part[self.end].iloc[0].timestamp() * 1000))
                new = False
        if changed:
            self.held.put([(k, *own) for k, own in held.items()])
        return iter(())

    def handleExpiredTimer(self, key: tuple[Any], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((k, tuple(own)[self.n :]) for k, *own in self.held.get())
        self.held.clear()
        yield _frame(self.tick, key[0], self.meter, self.values, held, {"complete": len(held) >= self.expected})

    def close(self) -> None:
        pass


class _Counted(StatefulProcessor):
    """Of one tick, or one part of it, how many meters have reported: says so as rows of what came new, or once when all have."""

    def __init__(self, keys: list[str], expected: int | None, ttl_ms: int | None) -> None:
        self.keys, self.expected, self.ttl_ms = keys, expected, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        more = int(sum(part["n"].sum() for part in rows))
        before = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((before + more,))
        told = more if self.expected is None else int(before < self.expected <= before + more)
        if told:
            yield pd.DataFrame({k: [v] for k, v in zip(self.keys, key, strict=True)} | {"n": [told]})

    def close(self) -> None:
        pass


class _Reported(StatefulProcessor):
    """A meter's first message of a tick, as a row; its later ones say nothing new."""

    def __init__(self, keys: list[str], ttl_ms: int | None) -> None:
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame({k: [v] for k, v in zip(self.keys, key, strict=True)} | {"n": [1]})

    def close(self) -> None:
        pass


class _Last(StatefulProcessor):
    """A meter's last reading of a tick, kept until the tick is told complete, then sent; a mark stays, and what comes after is dropped."""

    def __init__(self, tick: str, meter: str, order: list[str], values: list[str], ttl_ms: int | None) -> None:
        self.tick, self.meter, self.order, self.values, self.ttl_ms = tick, meter, order, values, ttl_ms
        self.n, self.columns = len(order), [*dict.fromkeys([tick, meter, *order, *values]), "_complete"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", ", ".join(["sent boolean", *(f"at{i} long" for i in range(self.n)), *(f"v{i} double" for i in range(len(self.values)))]), self.ttl_ms)

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        sent, *before = tuple(self.held.get() or (False,))
        if sent:
            for _ in rows:
                pass
            return
        best, complete = tuple(before) or None, False
        for part in rows:
            part = part.set_axis(self.columns, axis=1)  # over a union, names may be lost on the way here
            told = part["_complete"].astype(bool)
            complete = complete or bool(told.any())
            for _, own in _lasts(part[~told], self.meter, self.order, self.values):
                if best is None or best[: self.n] <= own[: self.n]:
                    best = own
        if best is not None and complete:
            yield _frame(self.tick, key[0], self.meter, self.values, [(key[1], best[self.n :])], {})
            self.held.update((True, *[None] * len(best)))
        elif best is not None:
            self.held.update((False, *best))

    def close(self) -> None:
        pass


def assembled(stream: DataFrame, meters: DataFrame, tick: str, meter: str, order: str | list[str], values: list[str], ttl_ms: int | None = None, salts: int | None = None) -> DataFrame:
    """tick, meter and values (doubles) of each tick, in the batch in which the last of meters (a column of that name, distinct) reports; the last reading by `order` (one or more longs) until then counts.

    For ticks of any number of meters: a reading meets only others of its tick and meter. First reports are counted in `salts` parts of a tick (unless given, 64 for over 4,096 meters, else none), and the parts'
    counts, a row each, by tick; a tick that has all its meters is told to each of them, which sends what it holds. So a key's state is one reading or one number. Readings of other meters, and those after their tick was sent, are dropped. With ttl_ms, what is held
    and the marks of what was sent are forgotten so long after they were written; else marks stay, so that nothing is sent twice however late it comes again.
    """
    _rocksdb(stream.sparkSession)
    orders = [order] if isinstance(order, str) else order
    known, mode = meters.select(meter).distinct(), "None" if ttl_ms is None else "ProcessingTime"
    expected = known.count()
    own = combined(stream.select(*dict.fromkeys([tick, meter, *orders, *values])).join(known, meter, "left_semi").select(*dict.fromkeys([tick, meter, *orders, *values])), [tick, meter], orders)
    at = f"{tick} {stream.schema[tick].dataType.simpleString()}"
    if ttl_ms is None and "spark.watermarkDelayMs" not in stream.schema[tick].metadata:  # by a watermark, Spark would drop marks and late ticks
        counts = own.select(tick, meter).dropDuplicates([tick, meter]).withColumn("n", F.lit(1).cast("long"))
    else:
        counts = own.select(tick, meter).groupBy(tick, meter).transformWithStateInPandas(_Reported([tick, meter], ttl_ms), f"{at}, {meter} string, n long", "Append", mode)
    parts = salts or (64 if expected > 4096 else None)
    if parts:
        counts = counts.select(tick, F.pmod(F.xxhash64(meter), F.lit(parts)).cast("int").alias("_salt"), "n").groupBy(tick, "_salt").transformWithStateInPandas(_Counted([tick, "_salt"], None, ttl_ms), f"{at}, _salt int, n long", "Append", mode)
    full = counts.select(tick, "n").groupBy(tick).transformWithStateInPandas(_Counted([tick], expected, ttl_ms), f"{at}, n long", "Append", mode)
    nothing = [F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in dict.fromkeys([*orders, *values])]
    told = full.join(known).select(tick, meter, *nothing, F.lit(True).alias("_complete"))  # a row for each meter of a tick that is sent
    both = own.withColumn("_complete", F.lit(False)).select(*told.columns).unionByName(told)
    return both.groupBy(tick, meter).transformWithStateInPandas(_Last(tick, meter, orders, values, ttl_ms), f"{at}, {meter} string, " + ", ".join(f"{v} double" for v in values), "Append", mode)


def _stateful(stream: DataFrame, processor: _Barrier | _Closed, columns: list[str], more: str, mode: str) -> DataFrame:
    """A barrier over a stream. Its maps and lists need the RocksDB state store, which the session is set to."""
    _rocksdb(stream.sparkSession)
    out = f"{processor.tick} {stream.schema[processor.tick].dataType.simpleString()}, {processor.meter} string, " + ", ".join(f"{v} double" for v in processor.values) + more
    return stream.select(*columns).groupBy(processor.tick).transformWithStateInPandas(processor, out, "Append", mode)


def completed(stream: DataFrame, tick: str, meter: str, order: str | list[str], values: list[str], expected: int, ttl_ms: int | None = None) -> DataFrame:
    """tick, meter and values (doubles) of each tick, once `expected` meters have reported; the last reading by `order` (one or more longs) counts.

    A tick is sent once, and what comes after is dropped. State is a reading for each meter of the open ticks, and a mark for each tick that was sent.
    With ttl_ms, readings and marks are forgotten so long after they were written.
    """
    orders = [order] if isinstance(order, str) else order
    return _stateful(stream, _Barrier(tick, meter, orders, values, expected, ttl_ms), [*dict.fromkeys([tick, meter, *orders, *values])], "", "None" if ttl_ms is None else "ProcessingTime")


def closed(stream: DataFrame, tick: str, meter: str, order: str | list[str], values: list[str], expected: int, end: str) -> DataFrame:
    """tick, meter, values, complete of each tick when the stream's watermark passes its end (a timestamp): the last readings, whatever came when; `complete` says
    whether `expected` meters reported, so ticks that lack one are told as well. Readings later than the watermark are dropped, and nothing of a tick stays behind."""
    orders = [order] if isinstance(order, str) else order
    marked = [f.name for f in stream.schema.fields if "spark.watermarkDelayMs" in f.metadata]  # without it late rows aren't known
    columns = [*dict.fromkeys([tick, meter, *orders, *values, end, *marked])]
    own = combined(stream.select(*columns), [tick, meter], orders, marked[0]) if len(marked) == 1 else stream
    return _stateful(own, _Closed(tick, meter, orders, values, expected, end), columns, ", complete boolean", "EventTime")


def tick_totals(stream: DataFrame, event_time: str, meter: str, value: str, width: str, late: str, expected: int, order: str | None = None) -> DataFrame:
    """tick, n_meters, total of complete windows, after the watermark has passed them, of each meter's last value (ties by `order`): no Python, state is dropped by the watermark."""
    last = F.max_by(value, F.struct(event_time, *([order] if order else [])))
    w = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), F.col(meter)).agg(last.alias("v"))
    return w.groupBy("window").agg(F.count("*").alias("n_meters"), F.sum("v").alias("total")).filter(F.col("n_meters") >= expected).select(F.col("window.start").alias("tick"), "n_meters", "total")


def appended(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", now: bool = True) -> StreamingQuery:
    """The stream as files below path; each micro-batch counts once. `now` ends after what is there.

    A state store's partition costs a batch the same however little it holds, so there are no more of them than cores, whatever number of shuffle partitions the session has; a checkpoint keeps the number it began with.
    """
    writer = stream.writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).option("header", True)
    writer = writer.trigger(availableNow=True) if now else writer.trigger(processingTime="1 second")
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, min(int(before), stream.sparkSession.sparkContext.defaultParallelism))
    try:
        return writer.start()  # takes the session's settings as they are now
    finally:
        conf.set(name, before)
