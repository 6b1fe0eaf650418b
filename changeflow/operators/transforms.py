"""Row transforms: functions from DataFrame to DataFrame, composed left to right."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.model import META, ColumnSpec, TableSpec, data_columns

Transform = Callable[[DataFrame], DataFrame]


def keep(predicate: Column | Callable[[DataFrame], Column]) -> Transform:
    """Rows for which the predicate is true."""
    return lambda df: df.filter(predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate)


def map_columns(**columns: Column) -> Transform:
    """One row to one row: the named columns are replaced."""
    return lambda df: df.withColumns(columns)


def map_rows(function: Callable, schema: str) -> Transform:
    """One row to one row by a function of pandas batches, for what column expressions can't say."""
    return lambda df: df.mapInPandas(function, schema)


#: How many copies a fan-out makes at most.
FANOUT = 3


def fanout_copies(mode: str = "all", n: int = 0) -> int:
    """`all`: 3; `first` with index n: 1 if n is under 3, else 0; `n`: n, but 3 at most."""
    low = mode.lower()
    if low == "all":
        return FANOUT
    if low == "first":
        return 1 if 0 <= n < FANOUT else 0
    if low == "n":
        return max(0, min(n, FANOUT))
    raise ValueError(f"unknown fan-out mode {mode!r}")


def fanout(mode: str = "all", n: int = 0) -> Transform:
    """Each row as often as the mode says."""
    copies = fanout_copies(mode, n)

    def apply(df: DataFrame) -> DataFrame:
        if copies == 0:
            return df.filter(F.lit(False))
        return df if copies == 1 else df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")

    return apply


def rename(pairs: list[tuple[str, str]]) -> Transform:
    """Columns renamed; of several rules for one name the first counts. Data stays as it is; field metadata goes."""
    rules: dict[str, str] = {}
    for old, new in pairs:
        rules.setdefault(old, new)
    return lambda df: df.select(*[F.col(f"`{c}`").alias(rules[c], metadata={}) if c in rules and c not in META else F.col(f"`{c}`") for c in df.columns])


def rename_spec(spec: TableSpec, pairs: list[tuple[str, str]]) -> TableSpec:
    """A renamed column keeps its type only."""
    rules: dict[str, str] = {}
    for old, new in pairs:
        rules.setdefault(old, new)
    return spec.with_columns([ColumnSpec(rules[c.name], c.type) if c.name in rules else c for c in spec.columns])


def select(indexes: list[int]) -> Transform:
    """Data columns by position, reordered or repeated; a position beyond the last gives null. `_origin` becomes null."""

    def apply(df: DataFrame) -> DataFrame:
        own, used, out = data_columns(df), {}, []
        for k, i in enumerate(indexes):
            name = own[i] if 0 <= i < len(own) else f"_missing{k}"
            used[name] = used.get(name, 0) + 1
            value = F.col(f"`{name}`") if 0 <= i < len(own) else F.lit(None).cast("string")
            out.append(value.alias(name if used[name] == 1 else f"{name}_{used[name]}"))
        meta = [F.lit(None).cast("string").alias(c) if c == "_origin" else F.col(c) for c in META if c in df.columns]
        return df.select(*out, *meta)

    return apply


def select_spec(spec: TableSpec, indexes: list[int]) -> TableSpec:
    """Positions beyond the last are left out of the schema."""
    return spec.with_columns([spec.columns[i] for i in indexes if 0 <= i < len(spec.columns)])


def sql(query: str, view: str = "source") -> Transform:
    """A Spark SQL query over the frame, under the name `view`. Catalyst plans it together with what stands around it."""

    def apply(df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(query, **{view: df}) if f"{{{view}}}" in query else _with_view(df, query, view)

    return apply


def _with_view(df: DataFrame, query: str, view: str) -> DataFrame:
    import uuid

    name = f"{view}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(f"WITH `{view}` AS (SELECT * FROM `{name}`) {query}")


def compose(transforms: list[Transform]) -> Transform:
    return lambda df: reduce(lambda d, t: t(d), transforms, df)


def from_map(df: DataFrame, values: Column, spec: TableSpec) -> DataFrame:
    """Rows of a map column by the names of a table; a missing key gives null."""
    from changeflow.model import spark_type

    return df.select(*[F.try_element_at(values, F.lit(c.name)).try_cast(spark_type(c.type)).alias(c.name) for c in spec.columns], *[c for c in META if c in df.columns])
