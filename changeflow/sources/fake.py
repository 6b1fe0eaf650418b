"""Generated rows: (i, `fake-row-i`, whether i is even)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from changeflow.model import as_changes

SCHEMA = "f0 bigint, f1 string, f2 boolean"


def rows(spark: SparkSession, n: int = 10, prefix: str = "fake-row-", width: int = 3) -> DataFrame:
    """n rows; columns beyond the third are null."""
    i = F.col("id")
    out = [i.alias("f0"), F.concat(F.lit(prefix), i.cast("string")).alias("f1"), (i % 2 == 0).alias("f2")][:width]
    out += [F.lit(None).cast("string").alias(f"f{k}") for k in range(3, width)]
    return as_changes(spark.range(n).select(*out, "id"), seq=i).drop("id")


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FakeStream(DataSourceStreamReader):
    """Offsets are counts of rows: a restart goes on where the last committed batch ended."""

    def __init__(self, options: dict):
        self.total = int(options.get("row.num", -1))
        self.per_batch = int(options.get("rows.per.batch", 1000))
        self.parts = int(options.get("partitions", 1))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.at += self.per_batch
        return {"row": self.at if self.total < 0 else min(self.at, self.total)}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        self.at = max(self.at, end["row"])
        low, high = start["row"], end["row"]
        step = max(1, -(-(high - low) // self.parts))
        return [_Span(k, min(k + step, high)) for k in range(low, high, step)]

    def read(self, span: _Span):
        for i in range(span.start, span.end):
            yield i, f"fake-row-{i}", i % 2 == 0

    def commit(self, end: dict) -> None:
        pass


class FakeSource(DataSource):
    """`spark.readStream.format("changeflow-fake")`; row.num below 0 never ends."""

    @classmethod
    def name(cls) -> str:
        return "changeflow-fake"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FakeStream:
        return FakeStream(dict(self.options))


def stream(spark: SparkSession, n: int = -1, per_batch: int = 1000) -> DataFrame:
    spark.dataSource.register(FakeSource)
    return spark.readStream.format("changeflow-fake").option("row.num", n).option("rows.per.batch", per_batch).load()
