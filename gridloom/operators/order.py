"""Places, running totals and quantiles in a global order, without a task that sees all rows.

Rows are range-partitioned and sorted once; what a partition needs of those before it is a row for each partition, and only these meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.shared import staged


def _placed(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """df sorted over all partitions, with _part and _at, the place in it; written to the shared folder."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return staged(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))


def _with_base(placed: DataFrame, total: Column, kind: str = "long") -> DataFrame:
    """placed with _base, the total of the partitions before."""
    before, bases = 0, []
    for r in sorted(placed.groupBy("_part").agg(total.alias("total")).collect()):  # a row for each partition
        bases.append((r["_part"], before))
        before += r["total"] or 0
    base = F.broadcast(placed.sparkSession.createDataFrame(bases, f"_part long, _base {kind}"))
    return placed.join(base, "_part")


def numbered(df: DataFrame, *order: Column | str, by: tuple[str, ...] = (), name: str = "n") -> DataFrame:
    """df with a number from 0 in the order given, anew in each group of `by`.

    A number is the row's place in its partition plus the rows of the partitions before, less the group's first. `order` should end in a key that makes it total.
    """
    placed = _placed(df, [*by, *order])
    out = _with_base(placed, F.count("*")).withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
    if by:
        first = out.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(name).alias("_first"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        out = out.join(first, on).withColumn(name, F.col(name) - F.col("_first")).select(*df.columns, name)
    return out


def running(df: DataFrame, value: str, *order: Column | str, name: str = "total") -> DataFrame:
    """df with the sum of value (whole numbers) over all rows up to each, itself included, in a total order."""
    placed = _placed(df, order)
    within = F.sum(value).over(W.partitionBy("_part").orderBy("_at"))  # one partition of the sort
    return _with_base(placed.withColumn("_within", within), F.sum(value)).withColumn(name, F.coalesce("_within", F.lit(0)) + F.col("_base")).select(*df.columns, name)


def quantiles(df: DataFrame, value: str, at: Sequence[float]) -> list[float] | None:
    """The exact quantiles of a column of numbers, interpolated linearly at (n - 1) p; None if it has no values. Nulls don't count.

    Equal values are counted before anything is sorted. Sums of counts by partition tell which partitions hold the two ranks beside each place, and running counts there which values;
    the driver sees a row for each partition and two for each quantile.
    """
    counts = _placed(df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c")), ["v"])
    sums, first, total = counts.groupBy("_part").agg(F.sum("c").alias("c")).collect(), {}, 0  # a row for each partition
    for r in sorted(sums):
        first[r["_part"]] = total
        total += r["c"]
    if not total:
        return None
    places = [(total - 1) * p for p in at]
    ranks = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    parts = {k: max(p for p, n in first.items() if n <= k) for k in ranks}
    upto = F.sum("c").over(W.partitionBy("_part").orderBy("v"))
    near = counts.filter(F.col("_part").isin(sorted(set(parts.values())))).withColumn("_upto", upto)
    wanted = reduce(lambda a, b: a | b, [(F.col("_part") == parts[k]) & (F.col("_upto") > k - first[parts[k]]) & (F.col("_upto") - F.col("c") <= k - first[parts[k]]) for k in ranks])
    found = [(first[r["_part"]] + r["_upto"] - r["c"], r["c"], r["v"]) for r in near.filter(wanted).collect()]  # a row for each rank at most
    of = {k: next(v for start, n, v in found if start <= k < start + n) for k in ranks}
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(of[low] if of[low] == of[high] else (high - p) * of[low] + (p - low) * of[high])
    return out


def with_next(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """df with `column` of the next row of its group in the order given, null at the group's end. A group need not meet in one task: where it goes on in another partition, that one's first row tells."""
    placed = _placed(df, [*by, *order])
    first = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min_by(F.struct(*by, column), "_at").alias("f")).orderBy("_part").collect()  # a row for each partition
    kinds = ", ".join(f"_by{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    follows = [(r["_part"], r["n"] - 1, *after["f"]) for r, after in zip(first, first[1:], strict=False)]
    border = F.broadcast(df.sparkSession.createDataFrame(follows, f"_part long, _end long, {kinds}{', ' if kinds else ''}_first {df.schema[column].dataType.simpleString()}"))
    within = F.lead(column).over(W.partitionBy("_part", *by).orderBy("_at"))  # within one partition of the sort
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_at") == F.col("_end"))
    return placed.withColumn("_within", within).join(border, "_part", "left").withColumn(name, F.coalesce("_within", F.when(here, F.col("_first")))).select(*df.columns, name)
