"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task handles at a time.
SLICE_CHARS = 1_000_000
#: A key with over one part in so many of all rows is hot.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents. Files that can't be split into as many parts as there are cores are dealt out first; large tables have more parts."""
    docs = table(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master, one of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: later plans start there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def met(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined with few (a row, or a handful, for each key), where one key may hold a large part of rows.

    Keys of over 1 / HOT of all rows, of which there are less than HOT, find theirs in a table that all tasks are sent; the rest is dealt by key.
    `rows` is read three times.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    total = rows.count()
    hot = F.broadcast(counts.filter(F.col("_rows") * HOT > total).select(key))  # less than HOT rows
    often = rows.join(F.broadcast(few.join(hot, key, "left_semi")), key)
    return often.unionByName(rows.join(hot, key, "left_anti").join(few, key))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a staged table whose readers are done."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Give back what earlier tasks left free in this worker; for the start of a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about `limit` characters each, and their texts; a null text is an empty one. Only one part's texts are strings at a time."""
    own = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(own), 0)).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit)) + 1
        part = batch.slice(start, end - start)
        yield part, [t or "" for t in own.slice(start, end - start).to_pylist()]
        start = end


def starts_of(lens: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins."""
    out = np.zeros(len(lens), dtype=np.int64)
    np.cumsum(lens[:-1], out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i]:starts[i]+lens[i]], one after another."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts - starts_of(lens), lens)
    return flat[at]


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sum of each of consecutive runs; 0 for an empty run."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(lens)])
    return ends[at[1:]] - ends[at[:-1]]


class Words(dict):
    """Numbers for words in order of arrival; `fresh` lists those that came since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Pieces:
    """Runs of token ids, one for each word of a Words; grows in place."""

    def __init__(self) -> None:
        self.n = self.used = 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lens = np.zeros(1 << 14, dtype=np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(lens)] = self.used + starts_of(lens)
        self.lens[self.n : self.n + len(lens)] = lens
        self.used += len(ids)
        self.n += len(lens)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[numbers], self.lens[numbers])


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(lens.sum())), lens
