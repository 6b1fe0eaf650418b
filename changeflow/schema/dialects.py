"""SQL dialects: types in and out, DDL and DML text. Plan-time text functions; a dialect is a table of facts."""

from __future__ import annotations

from dataclasses import dataclass

from changeflow.model import ColumnSpec, TableSpec


def _decimal(kind: str) -> tuple[int, int]:
    p, s = kind[8:-1].split(",")
    return int(p), int(s)


@dataclass(frozen=True)
class Dialect:
    """quote: the mark around names. into: our type to the column's SQL type. outof: database type to ours.

    limits: the greatest precision and scale. key_text: the type of text in a key."""

    name: str
    quote: str
    into: dict[str, str]
    outof: dict[str, str]
    decimal: str
    limits: tuple[int, int]
    key_text: str
    casts: dict[str, str] | None = None

    def quoted(self, name: str) -> str:
        return f"{self.quote}{name}{self.quote}"

    def table(self, name: str) -> str:
        return ".".join(map(self.quoted, name.split(".")))

    def sql_type(self, column: ColumnSpec) -> str:
        kind = column.type
        if kind.startswith("decimal"):
            (p, s), (most, scale) = _decimal(kind), self.limits
            return f"{self.decimal}({min(max(p, 1), most)},{min(max(s, 0), scale)})"
        if kind.startswith("array<"):
            return f"{self.sql_type(ColumnSpec('', kind[6:-1]))}[]" if self.casts else self.into["json"]
        return self.key_text if kind == "string" and column.primary_key else self.into[kind]

    def type_of(self, db_type: str, length: int | None = None, scale: int | None = None) -> str:
        """Our type of a database's; `string` for unknown ones."""
        low = db_type.strip().lower()
        if low in ("decimal", "numeric", "decimal unsigned", "numeric unsigned"):
            return f"decimal({min(max(length or 10, 1), 65)},{min(max(scale or 0, 0), 30)})"
        if self.casts and low.startswith("_"):
            return f"array<{self.type_of(low[1:], length, scale)}>"
        if not self.casts and low == "tinyint" and length == 1:
            return "boolean"
        return self.outof.get(low, "string")

    def _definition(self, c: ColumnSpec, key: bool = False) -> str:
        column = ColumnSpec(c.name, c.type, c.nullable and not key and not c.primary_key, c.primary_key or key)
        return f"{self.quoted(c.name)} {self.sql_type(column)}{'' if column.nullable else ' NOT NULL'}"

    def create_table(self, spec: TableSpec) -> str:
        key = f", PRIMARY KEY ({', '.join(map(self.quoted, spec.primary_key))})" if spec.primary_key else ""
        return f"CREATE TABLE {self.table(spec.identifier)} ({', '.join(self._definition(c, c.primary_key) for c in spec.columns)}{key})"

    def add_column(self, table: str, c: ColumnSpec) -> list[str]:
        null = "" if c.nullable else " NOT NULL"
        return [f"ALTER TABLE {self.table(table)} ADD COLUMN {self.quoted(c.name)} {self.sql_type(c)}{null}"]

    def drop_column(self, table: str, name: str) -> list[str]:
        return [f"ALTER TABLE {self.table(table)} DROP COLUMN {self.quoted(name)}"]

    def rename_column(self, table: str, old: str, new: str) -> list[str]:
        return [f"ALTER TABLE {self.table(table)} RENAME COLUMN {self.quoted(old)} TO {self.quoted(new)}"]

    def modify_column(self, table: str, c: ColumnSpec) -> list[str]:
        if not self.casts:
            return [f"ALTER TABLE {self.table(table)} MODIFY COLUMN {self.quoted(c.name)} {self.sql_type(c)}{'' if c.nullable else ' NOT NULL'}"]
        alter = f"ALTER TABLE {self.table(table)} ALTER COLUMN {self.quoted(c.name)}"
        return [f"{alter} TYPE {self.sql_type(c)}", f"{alter} {'DROP' if c.nullable else 'SET'} NOT NULL"]

    def change(self, table: str, change) -> list[str]:
        """DDL of a schema change."""
        if change.action == "add":
            return self.add_column(table, change.column)
        if change.action == "drop":
            return self.drop_column(table, change.name)
        if change.action == "rename":
            return self.rename_column(table, change.name, change.to)
        return self.modify_column(table, change.column)

    def placeholder(self, n: int, kind: str) -> str:
        if self.casts is None:
            return "?"
        cast = "numeric" if kind.startswith("decimal") else "jsonb" if kind.startswith("array<") else self.casts.get(kind)
        return f"${n}::{cast}" if cast else f"${n}"

    def insert(self, table: str, columns: list[ColumnSpec], rows: int = 1) -> str:
        one = f"({', '.join(self.placeholder(i, c.type) for i, c in enumerate(columns, 1))})"
        return f"INSERT INTO {self.table(table)} ({', '.join(self.quoted(c.name) for c in columns)}) VALUES {', '.join([one] * rows)}"

    def upsert(self, table: str, columns: list[ColumnSpec], keys: list[str], rows: int = 1) -> str:
        sets = [self.quoted(c.name) for c in columns if c.name not in keys]
        head = self.insert(table, columns, rows)
        if self.casts is None:
            return head + (f" ON DUPLICATE KEY UPDATE {', '.join(f'{c} = VALUES({c})' for c in sets)}" if sets else "")
        what = f"UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in sets)}" if sets else "NOTHING"
        return f"{head} ON CONFLICT ({', '.join(map(self.quoted, keys))}) DO {what}"

    def delete(self, table: str, keys: list[ColumnSpec]) -> str:
        return f"DELETE FROM {self.table(table)} WHERE {' AND '.join(f'{self.quoted(c.name)} = {self.placeholder(i, c.type)}' for i, c in enumerate(keys, 1))}"


# The types of each database.
MYSQL = Dialect(
    "mysql", "`",
    into={
        "boolean": "TINYINT(1)", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "utinyint": "TINYINT UNSIGNED",
        "usmallint": "SMALLINT UNSIGNED", "uint": "INT UNSIGNED", "ubigint": "BIGINT UNSIGNED", "float": "FLOAT", "double": "DOUBLE", "string": "TEXT", "bytes": "BLOB",
        "json": "JSON", "date": "DATE", "time": "TIME", "datetime": "DATETIME", "timestamp": "TIMESTAMP", "duration": "BIGINT",
    },
    outof={
        "bool": "boolean", "boolean": "boolean", "tinyint": "tinyint", "smallint": "smallint", "smallint unsigned": "smallint", "mediumint": "int",
        "mediumint unsigned": "int", "int": "int", "integer": "int", "year": "int", "bigint": "bigint", "bigint unsigned": "bigint", "float": "float",
        "double": "double", "double precision": "double", "binary": "bytes", "varbinary": "bytes", "tinyblob": "bytes", "blob": "bytes",
        "mediumblob": "bytes", "longblob": "bytes", "bit": "bytes", "geometry": "bytes", "point": "bytes", "linestring": "bytes", "polygon": "bytes",
        "multipoint": "bytes", "multilinestring": "bytes", "multipolygon": "bytes", "geomcollection": "bytes", "date": "date", "time": "time",
        "datetime": "datetime", "timestamp": "timestamp",
    },
    decimal="DECIMAL", limits=(65, 30), key_text="VARCHAR(255)",
)
POSTGRES = Dialect(
    "postgres", '"',
    into={
        "boolean": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "utinyint": "NUMERIC(20,0)", "usmallint": "NUMERIC(20,0)",
        "uint": "NUMERIC(20,0)", "ubigint": "NUMERIC(20,0)", "float": "REAL", "double": "DOUBLE PRECISION", "string": "TEXT", "bytes": "BYTEA", "json": "JSONB", "date": "DATE",
        "time": "TIME", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "duration": "BIGINT",
    },
    outof={
        "bool": "boolean", "boolean": "boolean", "smallint": "smallint", "smallserial": "smallint", "int2": "smallint", "integer": "int",
        "serial": "int", "int4": "int", "bigint": "bigint", "bigserial": "bigint", "int8": "bigint", "real": "float", "float4": "float",
        "double precision": "double", "float8": "double", "money": "decimal(30,2)", "bytea": "bytes", "geometry": "bytes", "geography": "bytes",
        "date": "date", "time": "time", "timetz": "time", "timestamp": "datetime", "timestamptz": "timestamp",
    },
    decimal="NUMERIC", limits=(255, 127), key_text="TEXT",
    casts={
        "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "utinyint": "numeric", "usmallint": "numeric", "uint": "numeric", "ubigint": "numeric",
        "float": "real", "double": "double precision", "json": "jsonb", "date": "date", "time": "time", "datetime": "timestamp", "timestamp": "timestamptz", "duration": "bigint",
    },
)
TIDB = Dialect("tidb", "`", MYSQL.into, MYSQL.outof, "DECIMAL", (65, 30), "VARCHAR(255)")
DIALECTS = {d.name: d for d in (MYSQL, POSTGRES, TIDB)} | {"postgresql": POSTGRES}

#: A column store's types, and a search index's field types.
CLICKHOUSE = {
    "boolean": "UInt8", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "utinyint": "UInt8", "usmallint": "UInt16", "uint": "UInt32", "ubigint": "UInt64",
    "float": "Float32", "double": "Float64", "string": "String", "bytes": "String", "json": "String", "date": "Date", "time": "String", "datetime": "DateTime",
    "timestamp": "DateTime64(3, 'UTC')", "duration": "Int64",
}
SEARCH = {
    "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "long", "utinyint": "long", "usmallint": "long", "uint": "long", "ubigint": "long",
    "float": "float", "double": "double", "string": "keyword", "bytes": "keyword", "json": "object", "date": "date", "time": "keyword", "datetime": "date", "timestamp": "date", "duration": "long",
}


def clickhouse_table(spec: TableSpec) -> str:
    """With a key, a replacing merge tree: of rows with one key the last stays."""
    def kind(c: ColumnSpec) -> str:
        own = CLICKHOUSE.get(c.type, "String")
        if c.type.startswith("decimal"):
            p, scale = _decimal(c.type)
            own = f"Decimal({min(p, 76)}, {max(scale, 0)})"
        return f"Nullable({own})" if c.nullable and not c.primary_key else own

    keys = ", ".join(f"`{k}`" for k in spec.primary_key)
    engine = f"ReplacingMergeTree() ORDER BY ({keys})" if keys else "MergeTree() ORDER BY tuple()"
    return f"CREATE TABLE IF NOT EXISTS {MYSQL.table(spec.identifier)} ({', '.join(f'`{c.name}` {kind(c)}' for c in spec.columns)}) ENGINE = {engine}"


def search_mapping(spec: TableSpec) -> dict:
    kind = lambda c: "double" if c.type.startswith("decimal") else SEARCH.get(c.type.removeprefix("array<").rstrip(">"), "keyword")
    one = lambda c: {"type": kind(c)} | ({"enabled": True} if kind(c) == "object" else {})
    return {"mappings": {"properties": {c.name: one(c) for c in spec.columns}}}
