"""The filter operator with its own truth table, which differs from SQL's three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.model import data_columns

#: Names of operators.
OPERATORS = {
    "not_null": "not_null", "notnull": "not_null", "is_not_null": "not_null", "is_null": "is_null", "isnull": "is_null", "=": "=", "==": "=", "eq": "=", "equals": "=",
    "!=": "!=", "<>": "!=", "ne": "!=", ">": ">", "gt": ">", "<": "<", "lt": "<", ">=": ">=", "gte": ">=", "ge": ">=", "<=": "<=", "lte": "<=", "le": "<=",
}
EPSILON = 2.220446049250313e-16
#: What counts as a number in text: no white space, no type suffixes.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(x: Column, kind: T.DataType) -> Column | None:
    """x as a double; null where it is no number; None for types that are none at all (booleans and decimals too)."""
    if isinstance(kind, T.StringType):
        return F.when(F.rlike(x, F.lit(_NUMBER)), x.try_cast("double"))
    if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)):
        return x.cast("double")
    return None


def condition(x: Column, kind: T.DataType, operator: str = "not_null", value: str | float | bool | None = None) -> Column:
    """True or false for every row, never null."""
    op = OPERATORS.get(operator.strip().lower())
    if op is None:
        raise ValueError(f"unknown filter operator {operator!r}")
    if op in ("not_null", "is_null"):
        return x.isNotNull() if op == "not_null" else x.isNull()
    if op == "!=":
        return ~condition(x, kind, "=", value)
    if value is None or isinstance(value, bool):
        return F.lit(False)
    if op == "=" and isinstance(value, str) and isinstance(kind, T.StringType):
        return F.coalesce(x == F.lit(value), F.lit(False))
    want = value
    if isinstance(value, str):
        import re

        if not re.match(_NUMBER, value):
            return F.lit(False)
        want = float(value)
    number = _number(x, kind)
    if number is None:
        return F.lit(False)
    want = F.lit(float(want))
    test = {"=": F.abs(number - want) < EPSILON, ">": number > want, "<": number < want, ">=": number >= want, "<=": number <= want}[op]
    # Spark holds NaN for the greatest number; here no comparison with it holds.
    return F.coalesce(test & ~F.isnan(number), F.lit(False))


def filter_by_index(df: DataFrame, field_index: int, operator: str = "not_null", value=None) -> DataFrame:
    """Keep the rows whose data column at field_index meets the condition; none if there is no such column.

    Where SQL's own comparison decides the same, it is added, so that the scan can skip row groups."""
    names = data_columns(df)
    op = OPERATORS.get(operator.strip().lower())
    if op is None:
        raise ValueError(f"unknown filter operator {operator!r}")
    if not 0 <= field_index < len(names):
        return df.filter(F.lit(False))
    name = names[field_index]
    kind = df.schema[name].dataType
    x = F.col(f"`{name}`")
    keep = condition(x, kind, operator, value)
    if op in (">", "<", ">=", "<=") and isinstance(kind, (T.IntegralType, T.DoubleType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        keep = {">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value}[op] & keep
    return df.filter(keep)
