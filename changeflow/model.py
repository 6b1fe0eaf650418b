"""The data model: change rows as DataFrames, and table specifications.

A change frame has the data columns plus three columns of metadata: `_kind` (one of KINDS), `_origin` (`db.table` or
null) and `_seq` (bigint, the order of arrival). Operators on change frames carry all three unless they say otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, BEFORE, AFTER, DELETE = "INSERT", "UPDATE_BEFORE", "UPDATE_AFTER", "DELETE"
KINDS = (INSERT, BEFORE, AFTER, DELETE)
META = ("_kind", "_origin", "_seq")

#: One-letter codes of kinds. Upper case is understood for insert, update and delete too.
CODES = {INSERT: "c", AFTER: "u", BEFORE: "b", DELETE: "d"}
_READ = {"c": INSERT, "I": INSERT, "u": AFTER, "U": AFTER, "b": BEFORE, "d": DELETE, "D": DELETE}


def kind_from_code(code: Column) -> Column:
    """The kind of a code; null for others."""
    pairs = [x for k, v in _READ.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), code)


def kind_code(kind: Column) -> Column:
    pairs = [x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), kind)


def insert_like(kind: Column) -> Column:
    return kind.isin(INSERT, AFTER)


def delete_like(kind: Column) -> Column:
    return kind.isin(DELETE, BEFORE)


def as_changes(df: DataFrame, kind: Column | None = None, origin: Column | None = None, seq: Column | None = None) -> DataFrame:
    """df as a change frame. Without seq, an id that only grows within a partition is given."""
    return df.withColumns(
        {
            "_kind": kind if kind is not None else F.lit(INSERT),
            "_origin": (origin if origin is not None else F.lit(None)).cast("string"),
            "_seq": (seq if seq is not None else F.monotonically_increasing_id()).cast("bigint"),
        }
    )


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


#: Names of column types in configurations, and the Spark type that holds each.
SPARK_TYPES = {
    "boolean": "boolean", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint",
    "utinyint": "smallint", "usmallint": "int", "uint": "bigint", "ubigint": "decimal(20,0)",
    "float": "float", "double": "double", "string": "string", "bytes": "binary", "json": "string",
    "date": "date", "time": "string", "datetime": "timestamp_ntz", "timestamp": "timestamp", "duration": "bigint",
}
_ALIASES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "integer": "int", "int64": "bigint", "long": "bigint", "uint8": "utinyint",
    "uint16": "usmallint", "uint32": "uint", "uint64": "ubigint", "float32": "float", "float64": "double", "varchar": "string", "text": "string",
    "binary": "bytes", "timestamp_tz": "timestamp", "timestamptz": "timestamp",
}


def type_name(name: str) -> str:
    """The plain name of a configured type: `decimal(p,s)`, a key of SPARK_TYPES, or `string` for what isn't known."""
    low = name.strip().lower()
    if low.startswith(("decimal", "numeric")):
        inner = low[low.find("(") + 1 : low.rfind(")")] if "(" in low else "10,0"
        p, _, s = inner.partition(",")
        return f"decimal({int(p)},{int(s or 0)})"
    low = _ALIASES.get(low, low)
    return low if low in SPARK_TYPES else "string"


def spark_type(name: str) -> str:
    """DDL of the Spark type for a plain type name. Decimals beyond 38 digits are held as text."""
    if name.startswith("decimal"):
        return name if int(name[8:].split(",")[0]) <= 38 else "string"
    if name.startswith("array<"):
        return f"array<{spark_type(name[6:-1])}>"
    return SPARK_TYPES[name]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    nullable: bool = True
    primary_key: bool = False
    default: str | None = None
    comment: str | None = None
    source_type: str | None = None

    @property
    def field(self) -> T.StructField:
        extra = {"pk": self.primary_key, "default": self.default, "comment": self.comment, "source_type": self.source_type}
        return T.StructField(self.name, T.StructType.fromDDL(f"x {spark_type(self.type)}")[0].dataType, self.nullable, {k: v for k, v in extra.items() if v})


@dataclass(frozen=True)
class TableSpec:
    identifier: str
    columns: tuple[ColumnSpec, ...] = field(default_factory=tuple)
    comment: str | None = None

    @classmethod
    def of(cls, identifier: str, /, *pk: str, **types: str) -> TableSpec:
        return cls(identifier, tuple(ColumnSpec(k, type_name(v), primary_key=k in pk, nullable=k not in pk) for k, v in types.items()))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in self.columns)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def with_columns(self, columns: list[ColumnSpec]) -> TableSpec:
        return replace(self, columns=tuple(columns))


def align(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Positional alignment to a table: data columns take its names and types, missing ones are null, further ones go."""
    own = data_columns(df)
    data = [(F.col(f"`{own[i]}`") if i < len(own) else F.lit(None)).cast(spark_type(c.type)).alias(c.name) for i, c in enumerate(spec.columns)]
    return df.select(*data, *[c for c in META if c in df.columns])
