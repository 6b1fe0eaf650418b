"""Metrics of sinks and probes: sliding sums, moving averages, percentiles by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Pieces that the values of a group are cut into, so that a hot group is many tasks' work.
PARTS = 256


def _cut(df: DataFrame, by: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """df with `_part`, which grows with the value: the range of each group's values cut evenly. One part, if they aren't
    numbers or times. The ranges are one row per group."""
    kind = df.schema[value].dataType
    x = F.unix_micros(F.col(value)) if isinstance(kind, T.TimestampType) else F.col(value)
    if not isinstance(kind, (T.NumericType, T.TimestampType)):
        return df.withColumn("_part", F.lit(0))
    df = df.withColumn("_x", x.cast("double"))
    ends = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    wide = F.when(F.col("_high") > F.col("_low"), (F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts).otherwise(0.0)
    at = F.least(F.floor(F.coalesce(wide, F.lit(0.0))).cast("int"), F.lit(parts - 1))
    met = df.join(ends, same) if same else df.crossJoin(ends)  # without groups, one row
    return met.withColumn("_part", at).drop("_x", "_low", "_high", *[f"_by{i}" for i in range(len(by))])


def _before(df: DataFrame, by: list[str], number: Column, later: bool = False) -> DataFrame:
    """df with `_ahead`: the sum of number over the group's earlier (or later) parts; the window sees one row per part."""
    sums = df.groupBy(*by, "_part").agg(F.sum(number).alias("_sum"))
    order = Window.partitionBy(*by).orderBy(F.desc("_part") if later else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_ahead"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return df.join(ahead, [*same, F.col("_part") == F.col("_p")]).drop("_p", *[f"_by{i}" for i in range(len(by))])


def sliding(df: DataFrame, ts: str, by: list[str], seconds: int = 60, span: int = 60, **sums: str) -> DataFrame:
    """df with sums over the last so many seconds, up to and with each row; `max_<x>` asks for a maximum instead.

    A group is cut into stretches of span * seconds; what a stretch's first rows look back to is copied into it."""
    reach, width = seconds * 1_000_000, seconds * 1_000_000 * span
    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("_t") / width))
    both = F.array_compact(F.array("_own", F.when(F.col("_t") >= (F.col("_own") + 1) * width - reach, F.col("_own") + 1)))
    spread = timed.withColumn("_stretch", F.explode_outer(both))
    last = Window.partitionBy(*by, "_stretch").orderBy("_t").rangeBetween(-(reach - 1), 0)
    summed = spread.withColumns({k: (F.max(c) if k.startswith("max_") else F.sum(c)).over(last) for k, c in sums.items()})
    return summed.filter(F.col("_stretch").eqNullSafe(F.col("_own"))).drop("_t", "_own", "_stretch")


def ema(values: Column, alpha: float = 0.2) -> Column:
    """The exponential moving average of an array in order; the first value starts it, null for an empty array."""
    start = F.lit(None).cast("double")
    return F.aggregate(values, start, lambda acc, x: F.when(acc.isNull(), x.cast("double")).otherwise(x * alpha + acc * (1 - alpha)))


def ema_by(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """One row per group: the average of its values in order. A closed form, sum of weighted values, needs no list:
    the value k places before the last weighs alpha * (1 - alpha) ** k, the first one without alpha."""
    cut = _before(_cut(df, by, order), by, F.lit(1), later=True)
    back = Window.partitionBy(*by, "_part").orderBy(F.desc(order))
    ranked = cut.withColumn("_k", F.col("_ahead") + F.row_number().over(back) - 1)
    most = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    ranked = ranked.join(most, same) if same else ranked.crossJoin(most)  # without groups, one row
    weight = F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("_k"))
    return ranked.groupBy(*by).agg(F.sum(F.col(value) * weight).alias("ema"))


def nearest_rank(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles as the element at round((n - 1) * p) of the sorted values, from counts of distinct values: rows of a
    group never meet in one list."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    cut = _before(_cut(counts, by, value), by, F.col("_c"))
    order = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.sum("_c").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    summed = cut.withColumn("_upto", F.col("_ahead") + F.sum("_c").over(order))
    ranked = summed.join(total, same) if same else summed.crossJoin(total)  # without groups, one row
    at = lambda p: F.floor((F.col("_n") - 1) * p + 0.5)
    picks = [F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(k) for k, p in points.items()]
    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), *picks, (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("avg"), F.max(value).alias("max"))


def tumbling(df: DataFrame, ts: str, value: str, points: dict[str, float], by: list[str] | None = None, width: str = "10 seconds") -> DataFrame:
    """nearest_rank by windows of a fixed width, each named by its start (`window_start`); rows without a time are in none."""
    at = df.filter(F.col(ts).isNotNull()).withColumn("window_start", F.window(ts, width)["start"])
    return nearest_rank(at, [*(by or []), "window_start"], value, points)


def in_flight(sent: Column, delivered: Column, failed: Column) -> Column:
    """Never below zero."""
    return F.greatest(sent - delivered - failed, F.lit(0))


def resolved(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """The least timestamp over the members of a group: what all of them have reached."""
    return df.groupBy(*by).agg(F.min(ts).alias("resolved_ts"))
