"""Streams by stages and by the clock, and energy by timestamps."""

import datetime
import pathlib
import random

import duckdb
import pytest

from gridloom.operators import series
from gridloom.operators.order import with_next
from gridloom.plans import catalog, telemetry
from gridloom.streaming import barrier, clock


def test_assembled_sends_a_tick_once_across_restarts(spark, tmp_path):
    """Ticks come complete, in parts, with repeated, late and unknown meters; a key's state is one reading."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    meters = spark.createDataFrame([(m,) for m in "abbc"], "meter string")

    def go(name, rows):
        (source / name).write_text("\n".join(f'{{"tick": {t}, "meter": "{m}", "at": {a}, "v": {"null" if v is None else v}}}' for t, m, a, v in rows))
        stream = barrier.replayed(spark, str(source), "tick long, meter string, at long, v double")
        barrier.appended(barrier.assembled(stream, meters, "tick", "meter", "at", ["v"], salts=2), str(out), f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r["tick"], r["meter"], r["v"]) for r in spark.read.parquet(str(out)).collect())

    first = [(1, "a", 2.0), (1, "b", None), (1, "c", 3.0)]
    assert go("1.json", [(1, "a", 1, 1.0), (2, "a", 1, 5.0), (1, "a", 3, 2.0), (1, "b", 1, None), (1, "c", 1, 3.0), (1, "stranger", 1, 9.0), (3, "stranger", 1, 1.0)]) == first
    assert go("2.json", [(1, "a", 9, 8.0), (2, "b", 7, 6.0), (2, "a", 0, 7.0), (2, "b", 7, 7.0)]) == first
    assert go("3.json", [(2, "c", 1, 1.0), (1, "c", 9, 8.0), (2, "b", 6, 0.0)]) == [*first, (2, "a", 5.0), (2, "b", 7.0), (2, "c", 1.0)]


def test_clock_goes_on_from_its_checkpoint(spark, tmp_path):
    sent = spark.createDataFrame([(t, m) for t in range(9) for m in "ab"], "timestamp long, meter string")
    for last, fast in ((4, None), (9, 50.0)):
        stream = clock.replayed_ticks(spark, sent, at_once=2, per_second=fast, last=last)
        run = barrier.appended(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", now=False)
        try:
            for _ in range(40):
                run.processAllAvailable()
                if spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count() >= 2 * last:
                    break
        finally:
            run.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(t, m) for t in range(9) for m in "ab"]


def test_clock_keeps_its_pace():
    reader = clock.TickClock({"last": "1000", "at_once": "1000", "per_second": "1"}).simpleStreamReader(None)
    rows, end = reader.read({"tick": 10})
    assert list(rows) == [(10,)] and end == {"tick": 11}
    assert list(reader.readBetweenOffsets({"tick": 3}, {"tick": 5})) == [(3,), (4,)]


@pytest.mark.parametrize("seed", [0, 1])
def test_next_rows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, *["hot"] * 9]), i, rng.randrange(50)) for i in range(400)]
    got = {r["i"]: r["after"] for r in with_next(spark.createDataFrame(rows, "g string, i int, t int"), ["g"], ["t", "i"], "t", "after").collect()}
    want, order = {}, sorted(rows, key=lambda r: (str(r[0]), r[2], r[1]))
    for a, b in zip(order, [*order[1:], None], strict=True):
        want[a[1]] = b[2] if b and b[0] == a[0] else None
    assert got == want


def test_demand_adds_up_to_the_whole(spark):
    """Readings at uneven times, some over several hours, some at the same moment."""
    rng, t0 = random.Random(3), datetime.datetime(2024, 3, 1)
    rows = [(m, i, t0 + datetime.timedelta(seconds=rng.choice([0, 3600, 7200, rng.randrange(90_000)])), float(rng.randrange(-3, 9))) for m in "ab" for i in range(60)]
    spans = series.with_spans(spark.createDataFrame(rows, "m string, i int, ts timestamp_ntz, kw double"), ["m"], "ts", ["i"])
    got = {(r["m"], r["start"]): r["kwh"] for r in series.demand(spans, ["m"], "ts", "kw", "hour").collect()}
    want = {}
    for m in "ab":
        own = sorted((t, i, kw) for x, i, t, kw in rows if x == m)
        for (t, _, kw), (until, _, _) in zip(own, own[1:], strict=False):
            at = t
            while at < until:
                hour = at.replace(minute=0, second=0)
                end = min(until, hour + datetime.timedelta(hours=1))
                want[m, hour] = want.get((m, hour), 0.0) + kw * (end - at).total_seconds() / 3600
                at = end
    assert got == pytest.approx(want)
    whole = {r["m"]: r["kwh"] for r in spans.selectExpr("m", "kw * hours AS e").groupBy("m").agg({"e": "sum"}).toDF("m", "kwh").collect()}
    assert {m: sum(v for (x, _), v in got.items() if x == m) for m in "ab"} == pytest.approx(whole)


def _events(spark, path, days, n=1200):
    """Events at random times of these days, which many hours lack a kind of, with ids that don't follow time."""
    rng, t0 = random.Random(5), datetime.datetime(2020, 1, 1)
    rows = [(i, t0 + datetime.timedelta(days=rng.choice(days), minutes=rng.randrange(150)), rng.choice("abcde"), float(rng.randrange(99))) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return duck


@pytest.fixture
def runs(monkeypatch):
    """Streams that ran, each with its number of batches and of its state's partitions."""
    seen, started = [], barrier.appended

    def appended(stream, path, checkpoint, *more, **named):
        run = started(stream, path, checkpoint, *more, **named)
        run.awaitTermination()
        at = pathlib.Path(checkpoint.removeprefix("file://"))
        seen.append((len(list((at / "commits").glob("[0-9]*"))), len(list((at / "state" / "0").glob("[0-9]*")))))
        return run

    monkeypatch.setattr(barrier, "appended", appended)
    return seen


@pytest.mark.parametrize("name, days", [("incomplete_ticks_stream", range(2900)), ("tick_barrier_stream", [*range(30), *range(1000, 1030)]), ("watermark_totals", [*range(30), *range(1000, 1030)])])
def test_streams_over_years_in_many_files(spark, tmp_path, monkeypatch, runs, name, days):
    """Readings of years come in no order, and none is late. Batches take more files where there are many, and the state has no more partitions than there are cores."""
    monkeypatch.setattr(telemetry, "FILE_ROWS", 30)
    duck, conf, before = _events(spark, tmp_path, days), "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(conf, 9)
    try:
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert spark.conf.get(conf) == "9"
    finally:
        spark.conf.set(conf, before)
    assert got and got == sorted(duck.sql(catalog.ORACLES[name]).fetchall())
    assert [(n <= 12, parts) for n, parts in runs] == [(True, spark.sparkContext.defaultParallelism)]  # of 40 files and one


def test_emitting_in_many_files(spark, tmp_path, monkeypatch, runs):
    monkeypatch.setattr(telemetry, "FILE_ROWS", 30)
    duck = _events(spark, tmp_path, range(60))
    got = sorted(map(tuple, catalog.QUERIES["tick_barrier_emitting"](spark, str(tmp_path)).collect()))
    assert got and got == sorted(duck.sql(catalog.ORACLES["tick_barrier_emitting"]).fetchall())
    assert [n <= 16 for n, _ in runs] == [True] * 3 and runs[0][0] < runs[1][0] < runs[2][0]  # of 80 files; it goes on each time


@pytest.mark.parametrize("seed, limit", [(0, 50_000), (1, 40), (2, 7)])
def test_combined_readings_are_those_that_may_count(spark, monkeypatch, seed, limit):
    """Whatever a watermark drops, the last reading of those left is the same; without an event time, one of a key is left of what a task has."""
    monkeypatch.setattr(barrier, "COMBINED_ROWS", limit)
    rng = random.Random(seed)
    when = lambda h: None if h is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=h)
    rows = [(rng.choice([1, 2, None]), rng.choice("abc"), rng.randrange(30), rng.choice([None, *range(9)]) if i % 9 else None, when(rng.choice([None, *range(40)])), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "tick long, meter string, at long, n long, ts timestamp_ntz, v double").coalesce(1)
    whole = lambda r: r[2] is not None and r[3] is not None

    def best(found, least=None):
        out = {}
        for r in found:
            if whole(r) and (least is None or r[4] is None or r[4] > when(least)):
                out[r[:2]] = max(out.get(r[:2], (-1,)), (r[2], r[3]))
        return out

    kept = [tuple(r) for r in barrier.combined(df, ["tick", "meter"], ["at", "n"], "ts").collect()]
    assert len(kept) < 400 and set(kept) <= set(rows) and {r for r in rows if None in r[2:5]} <= set(kept) and max(r[4] for r in kept if r[4]) == max(r[4] for r in rows if r[4])
    assert all(best(kept, h) == best(rows, h) for h in range(-1, 41))
    last = [tuple(r) for r in barrier.combined(df, ["tick", "meter"], ["at", "n"]).collect()]
    assert best(last) == best(rows)
    if limit == 50_000:
        assert len([r for r in last if whole(r)]) == len(best(rows))
        assert {r[:2]: r for r in last if whole(r)} == {r[:2]: r for r in sorted(filter(whole, rows), key=lambda r: (r[2], r[3]))}  # of equal ones the last that came


def test_assembled_without_parts_goes_on(spark, tmp_path):
    source, held, sent = tmp_path / "in", {}, {}
    source.mkdir()
    rng, meters = random.Random(7), spark.createDataFrame([(m,) for m in "abcd"], "meter string")
    for k, own in enumerate([{1: "abc", 2: "abcd", 3: "a"}, {1: "abcd", 2: "bc", 3: "bcd"}]):
        part = [(t, m, at, rng.random()) for t, ms in own.items() for m in ms for at in rng.sample(range(99), 5)]
        (source / f"{k}.json").write_text("\n".join(f'{{"tick": {t}, "meter": "{m}", "at": {a}, "v": {v}}}' for t, m, a, v in part))
        stream = barrier.replayed(spark, str(source), "tick long, meter string, at long, v double")
        barrier.appended(barrier.assembled(stream, meters, "tick", "meter", "at", ["v"]), str(tmp_path / "out"), f"{tmp_path}/checkpoint").awaitTermination()
        for t, m, a, v in part:
            held[t, m] = max(held.get((t, m), (-1, 0.0)), (a, v))
        sent |= {t: {(t, m, held[t, m][1]) for m in "abcd"} for t in own if t not in sent and all((t, m) in held for m in "abcd")}
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set().union(*sent.values())
    assert len(sent) == 3
