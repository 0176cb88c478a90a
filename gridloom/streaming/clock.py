"""A clock of ticks as a streaming source: it deals the numbers of ticks at a pace and goes on from its checkpoint."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class TickClock(DataSource):
    """Ticks `first` to `last` (exclusive), `at_once` in each batch and, if `per_second` is set, so many a second. Its offset is the next tick, so a query that begins again deals none twice and leaves none out."""

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return "tick long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        option = {k: float(v) for k, v in self.options.items() if k in ("first", "last", "at_once", "per_second")}
        return _Reader(int(option.get("first", 0)), int(option["last"]), int(option.get("at_once", 1)), option.get("per_second"))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, first: int, last: int, at_once: int, per_second: float | None) -> None:
        self.first, self.last, self.at_once, self.per_second = first, last, at_once, per_second
        self.began: tuple[float, int] | None = None

    def initialOffset(self) -> dict:
        return {"tick": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["tick"]
        if self.began is None:
            self.began = time.monotonic(), at
        due = self.last if self.per_second is None else self.began[1] + 1 + int((time.monotonic() - self.began[0]) * self.per_second)
        end = max(at, min(self.last, at + self.at_once, due))
        return iter([(t,) for t in range(at, end)]), {"tick": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(t,) for t in range(start["tick"], end["tick"])])


def replayed_ticks(spark: SparkSession, messages: DataFrame, tick: str = "timestamp", at_once: int = 1, per_second: float | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """A stream of messages (tick: a whole number) tick by tick, in order. The clock's ticks, a few rows in a batch, are sent to the tasks that read messages: keep these in folders by tick, so that a batch reads its own alone."""
    spark.dataSource.register(TickClock)
    end = last if last is not None else (messages.agg(F.max(tick)).first()[0] or -1) + 1
    clock = spark.readStream.format("ticks").options(first=first, last=end, at_once=at_once)
    clock = clock.option("per_second", per_second) if per_second else clock
    return messages.join(F.broadcast(clock.load().withColumnRenamed("tick", "_tick")), F.col(tick) == F.col("_tick")).drop("_tick")  # `at_once` rows
