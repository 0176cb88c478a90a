"""Time series: alignment, barriers by tick, shapes, energy, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.order import numbered, with_next


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The i-th row of left beside the i-th of right, with i; fails if their counts differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be paired with {m}")
    return numbered(left, *left_order, name="i").join(numbered(right, *right_order, name="i"), "i")


def aligned(rows: DataFrame, series: str, order: list[str]) -> DataFrame:
    """rows with tick, their place in their series, cut at the length of the shortest series."""
    shortest = F.broadcast(rows.groupBy(series).count().agg(F.min("count").alias("_least")))  # one row
    return numbered(rows, *order, by=(series,), name="tick").crossJoin(shortest).filter("tick < _least").drop("_least")


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key: an upsert in which the last write wins."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def barrier(rows: DataFrame, tick: str, meter: str, order: list[str], values: list[str], expected: int) -> DataFrame:
    """The last row of each meter, for the ticks in which at least `expected` meters have reported."""
    last = latest(rows, [tick, meter], order, values)
    full = last.groupBy(tick).agg(F.count("*").alias("_n")).filter(F.col("_n") >= expected).select(tick)
    return last.join(full, tick, "left_semi")


def incomplete(rows: DataFrame, tick: str, meter: str, expected: int) -> DataFrame:
    """tick, n_meters of the ticks that wait."""
    return rows.select(tick, meter).distinct().groupBy(tick).agg(F.count("*").alias("n_meters")).filter(F.col("n_meters") < expected)


def overridden(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns that changes give for a key."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.select(*[c for c in base.columns if c not in columns], *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def first_steps(rows: DataFrame, series: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each series with step, their number from 0. What can't be among them is left out before series are dealt, so a long series meets nowhere whole."""
    place = F.row_number().over(W.partitionBy(series).orderBy(*order))
    first = rows.withColumn("step", place).filter(F.col("step") <= n)
    return first.withColumn("step", F.col("step").cast("long") - 1).drop(*[c for c in order if c != series])


def dispatched(units: DataFrame, values: DataFrame, shapes: DataFrame) -> DataFrame:
    """name, device, bus, step, t_s, kw of generating units (name, device, bus, kw, duty): loads below zero that follow their shape (values: shape, step, mult; shapes: name, interval_s). Names in any case."""
    known = shapes.select(F.lower("name").alias("_shape"), "interval_s")
    at = values.select(F.lower("shape").alias("_shape"), "step", "mult").join(known, "_shape")
    out = units.withColumn("_shape", F.lower("duty")).join(at, "_shape")
    return out.select("name", "device", "bus", "step", (F.col("step") * F.col("interval_s")).alias("t_s"), (-F.col("kw") * F.col("mult")).alias("kw"))


def normalized(shape: DataFrame, by: str, value: str) -> DataFrame:
    """shape with `value` divided by its greatest in each group."""
    most = shape.groupBy(F.col(by).alias("_by")).agg(F.max(value).alias("_most"))
    return shape.join(most, F.col(by) == F.col("_by")).drop("_by").withColumn(value, F.col(value) / F.nullif(F.col("_most"), F.lit(0.0))).drop("_most")


def with_spans(rows: DataFrame, by: list[str], time: str, tie: list[str]) -> DataFrame:
    """rows with `until`, when the next reading of the same meter comes, and `hours`, how long that is; a meter's last reading lasts no time."""
    out = with_next(rows, by, [time, *tie], time, "until").withColumn("until", F.coalesce("until", time))
    return out.withColumn("hours", F.timestamp_diff("MICROSECOND", F.col(time), F.col("until")) / 3.6e9)


def energy(rows: DataFrame, by: list[str], order: list[str], kw: str, hours: float | Column, name: str = "kwh") -> DataFrame:
    """rows with the energy used so far in each group."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.col(kw) * hours).over(w))


def demand(rows: DataFrame, by: list[str], time: str, kw: str, width: str) -> DataFrame:
    """by, start, kwh, peak of each demand interval (`width`: hour or day) from rows of `with_spans`: a reading's energy is split where intervals meet, so their sums are the whole."""
    step, one = F.date_trunc(width, time).cast("timestamp_ntz"), F.expr(f"INTERVAL 1 {width}")
    parts = rows.filter(F.col("until") > F.col(time)).withColumn("start", F.explode(F.sequence(step, F.col("until"), one)))
    first, last = F.greatest(F.col(time), F.col("start")), F.least(F.col("until"), F.col("start") + one)
    hours = F.timestamp_diff("MICROSECOND", first, last) / 3.6e9
    return parts.withColumn("hours", hours).filter("hours > 0").groupBy(*by, "start").agg(F.sum(F.col(kw) * F.col("hours")).alias("kwh"), F.max(kw).alias("peak"))


def bulk_set(rows: DataFrame, name: str, pattern: str, column: str, value: str | float, otherwise: str | float | None = None) -> DataFrame:
    """rows with a column set where the name matches a pattern; elsewhere it stays, or is `otherwise` where rows lack it."""
    rest = F.col(column) if column in rows.columns else F.lit(otherwise)
    return rows.withColumn(column, F.when(F.col(name).rlike(pattern), F.lit(value)).otherwise(rest))


def scaled(rows: DataFrame, column: str, factor: float) -> DataFrame:
    """rows with a column by a factor: a multiplier of all loads."""
    return rows.withColumn(column, F.col(column) * factor)


def monitored(rows: DataFrame, element: str, name: str, time: str, width: str, channels: dict[str, Column]) -> DataFrame:
    """One element's channels (name: aggregate) by spans of time."""
    return rows.filter(F.col(element) == name).groupBy(F.date_trunc(width, time).cast("timestamp_ntz").alias(width)).agg(*[c.alias(k) for k, c in channels.items()])


def recorded(rows: DataFrame, monitors: DataFrame, element: str, time: str, width: str, channels: dict[str, Column]) -> DataFrame:
    """name, `width` and channels of what each of monitors (name, element) sees of its element, in any case, by spans of time; rows are summed by element before monitors meet them."""
    spans = rows.groupBy(F.lower(element).alias("_element"), F.date_trunc(width, time).cast("timestamp_ntz").alias(width)).agg(*[c.alias(k) for k, c in channels.items()])
    return monitors.select("name", F.lower("element").alias("_element")).join(spans, "_element").drop("_element")


def exceeding(rows: DataFrame, by: str, value: str, limit: float) -> DataFrame:
    """by, n, worst: how often and how far a value is over its limit."""
    return rows.filter(F.col(value) > limit).groupBy(by).agg(F.count("*").alias("n"), F.max(value).alias("worst"))


def power_factor(kw: Column, kvar: Column) -> Column:
    return kw / F.nullif(F.sqrt((kw * kw + kvar * kvar).cast("double")), F.lit(0.0))


#: Voltage bases of the feeder and of what lies behind its load transformer (fixed values).
PRIMARY_KV, SECONDARY_KV = 4.16, 0.48


def voltage_base(secondary: Column) -> Column:
    """A bus's base by its zone."""
    return F.when(secondary, SECONDARY_KV).otherwise(PRIMARY_KV)


def telemetry(readings: DataFrame, solved: DataFrame, key: str) -> DataFrame:
    """readings beside what was solved for their load; those without stay."""
    return readings.join(solved, key, "left")


def named_alike(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows whose names agree but for their case, joined."""
    low = right.withColumn("_name", F.lower(name)).drop(name)
    return left.join(low, F.lower(name) == F.col("_name")).drop("_name")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(key), key, "left_anti")


def band(pu: Column, low: float = 0.95, high: float = 1.05) -> Column:
    return F.when(pu < low, "low").when(pu > high, "high").otherwise("normal")


def scenario(n: int, step_s: int, spark) -> DataFrame:
    """step, t_s of a run of n steps."""
    return spark.range(n).select(F.col("id").alias("step"), (F.col("id") * step_s).alias("t_s"))
