"""Delimited text: one line, fields between bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.display import display
from changeflow.model import INSERT, META, TableSpec, data_columns, spark_type

DELIMITER = "|"


def _typed(field: Column, kind: str) -> tuple[Column, Column]:
    """The value, and whether the field can be read as the type at all."""
    if kind == "boolean":
        low = F.lower(field)
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False), F.lit(True)
    if kind in ("int", "bigint", "double"):
        pattern = r"^[+-]?[0-9]+$" if kind != "double" else r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
        value = F.when(F.rlike(field, F.lit(pattern)), field.try_cast(kind))
        return value, field.isNull() | value.isNotNull()
    return field.try_cast(spark_type(kind)), F.lit(True)


def decode(df: DataFrame, column: str, spec: TableSpec, delimiter: str = DELIMITER) -> DataFrame:
    """Empty fields are null; a message with a field that isn't of its number type is skipped."""
    line = F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), r"\n+\z", ""), r"\r+\z", "")
    got = df.filter(F.col(column).isNotNull()).withColumn("_fields", F.split(line, re.escape(delimiter), -1))
    out, good = [], F.lit(True)
    for i, c in enumerate(spec.columns):
        field = F.nullif(F.get("_fields", F.lit(i)), F.lit(""))
        value, ok = _typed(field, c.type)
        out.append(value.alias(c.name))
        good = good & ok
    origin = F.col("_origin") if "_origin" in df.columns else F.lit(None).cast("string")
    seq = F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id()
    return got.filter(good).select(*out, F.lit(INSERT).alias("_kind"), origin.alias("_origin"), seq.alias("_seq"), F.lit(0).alias("_turn"))


def joined(df: DataFrame, names: list[str], delimiter: str) -> Column:
    """Data columns as text, null as nothing."""
    return F.concat_ws(delimiter, *[F.coalesce(display(F.col(f"`{n}`"), df.schema[n].dataType), F.lit("")) for n in names])


def encode(df: DataFrame, spec: TableSpec, delimiter: str = DELIMITER) -> DataFrame:
    own = data_columns(df)[: len(spec.columns)]
    missing = [F.lit("")] * (len(spec.columns) - len(own))
    parts = [F.coalesce(display(F.col(f"`{n}`"), df.schema[n].dataType), F.lit("")) for n in own] + missing
    return df.select(*[c for c in META if c in df.columns], F.concat_ws(delimiter, *parts).alias("message"))
