"""How bounded tables are cut into ranges that are read side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """[start, end) of a split column, and the subtask that reads it."""

    start: int
    end: int
    subtask: int

    def predicate(self, column: str) -> str:
        return f"{column} >= {self.start} AND {column} < {self.end}"


def ranges(low: int | None, high: int | None, parts: int, most: int | None = None) -> list[Range]:
    """Closed bounds cut into `parts` ranges of equal width, none wider than `most`; no bounds, no ranges."""
    if low is None or high is None:
        return []
    width = max(1, -(-(high - low + 1) // parts))
    if most is not None:
        width = min(width, most)
    return [Range(start, min(start + width, high + 1), k % parts) for k, start in enumerate(range(low, high + 1, width))]


def snapshot_ranges(low: int | None, high: int | None, parallelism: int, split_size: int = 8096) -> list[Range]:
    return ranges(low, high, parallelism, split_size)


def predicates(column: str, low: int | None, high: int | None, parts: int) -> list[str]:
    """For `spark.read.jdbc(predicates=...)`: these ranges, not Spark's own strides."""
    return [r.predicate(column) for r in ranges(low, high, parts)]


def with_range(df: DataFrame, column: str, low: int, high: int, parts: int, most: int | None = None) -> DataFrame:
    """df with `_range` and `_subtask`, by arithmetic on the column."""
    width = max(1, -(-(high - low + 1) // parts))
    width = min(width, most) if most is not None else width
    at = F.floor((F.col(column) - low) / width).cast("bigint")
    return df.withColumn("_range", at).withColumn("_subtask", F.pmod(at, F.lit(parts)))


def keyset_page(df: DataFrame, column: str, after: int | None, until: int | None, size: int) -> DataFrame:
    """One page of a scan in key order: keys beyond `after` and below `until`."""
    if after is not None:
        df = df.filter(F.col(column) > after)
    if until is not None:
        df = df.filter(F.col(column) < until)
    return df.orderBy(column).limit(size)


def offset_page(df: DataFrame, column: str, offset: int, size: int) -> DataFrame:
    return df.orderBy(column).offset(offset).limit(size)
