"""Contiguous shards of nearly equal bytes, from prefix sums over sorted partitions.

Rows are range-partitioned and sorted by doc_id (only doc_id, size and checksum move, never texts). Each partition
adds up its own sizes; the totals, one row a partition, give every partition's offset, so no
row meets another partition's. A row whose middle byte lies in the k-th of n equal parts goes to shard k,
hence a shard's bytes differ from the target by less than its two border rows.

A null text has size 1 (no bytes, plus 1) and checksum 0. Null doc_ids come first. Repeated rows and
rows that share a doc_id all stay, next to each other, and may be cut apart between shards. An empty table gives no rows; other
columns are left out. A hot doc_id is no problem: ties are split by checksum, size and arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import documents, staged, starts_of


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in a shard) of every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), F.monotonically_increasing_id().alias("arrival")
    )
    keys = ["doc_id", "text_crc32", "size", "arrival"]
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, index = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes, k = np.asarray(batch.column(1)), batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(k, part, dtype=np.int32)), pa.array(before + starts_of(sizes)), pa.array(index + np.arange(k))], ["doc_id", "size", "text_crc32", "part", "before", "index"])
            before, index = before + int(sizes.sum()), index + k

    summed, _ = staged(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(add_up, "doc_id long, size long, text_crc32 long, part int, before long, index long"), "sizes")
    totals = sorted(summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())  # a row for each partition
    bases, total, count = [], 0, 0
    for r in totals:
        bases.append((r["part"], total, count))
        total, count = total + r["bytes"], count + r["rows"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base_bytes long, base_rows long"))  # as many rows as partitions
    out = summed.join(base, "part").withColumn("start", F.col("base_bytes") + F.col("before")).withColumn("row", F.col("base_rows") + F.col("index"))
    out = out.withColumn("shard", F.expr(f"CAST(((2 * start + size) * {shards}) div {max(1, 2 * total)} AS INT)"))
    first = F.broadcast(out.groupBy("shard").agg(F.min("row").alias("first")))  # as many rows as shards
    return out.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op7_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placed(documents(spark, sf_dir, "doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
