"""What a database says of its tables, over Python's DB-API: which there are, their columns, keys and numbers of rows.

A few rows of metadata, read by the driver; rows of tables are read by Spark's own JDBC source."""

from __future__ import annotations

from pathlib import Path

from changeflow.model import ColumnSpec, TableSpec
from changeflow.sinks import dbapi

_HERE = {"mysql": "DATABASE()", "postgresql": "current_schema()"}
#: Of a type, the form that tells signs and widths apart.
_TYPE = {"mysql": "column_type", "postgresql": "udt_name"}


class Catalog:
    """url: as a database sink's. Tables are named `table` or `schema.table`."""

    def __init__(self, url: str, user: str | None = None, password: str | None = None):
        self.url, self.kind, self.dialect = url, dbapi.kind_of(url), dbapi.dialect_of(url)
        self._who = {"user": user, "password": password}

    def _ask(self, sql: str, *values) -> list[tuple]:
        con = dbapi.connect(self.url, **self._who)
        try:
            cursor = con.cursor()
            cursor.execute(sql.replace("?", dbapi.MODULES[self.kind][1]), values)
            return [tuple(r) for r in cursor.fetchall()]
        finally:
            con.close()

    def _where(self, table: str) -> tuple[str, list[str]]:
        schema, _, name = table.rpartition(".")
        return f"table_name = ? AND table_schema = {'?' if schema else _HERE[self.kind]}", [name, *([schema] if schema else [])]

    def _there(self) -> bool:
        # Asking a file database that isn't there would make it.
        return self.kind != "sqlite" or Path(self.url.removeprefix("jdbc:").split(":", 1)[1]).exists()

    def tables(self) -> list[str]:
        if not self._there():
            return []
        if self.kind == "sqlite":
            return [r[0] for r in self._ask("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return [r[0] for r in self._ask(f"SELECT table_name FROM information_schema.tables WHERE table_schema = {_HERE[self.kind]} ORDER BY table_name")]

    def exists(self, table: str) -> bool:
        return self.spec(table) is not None

    def count(self, table: str) -> int:
        return self._ask(f"SELECT count(*) FROM {self.dialect.table(table)}")[0][0]

    def spec(self, table: str) -> TableSpec | None:
        """The table's columns in order, with its key; None if there is no such table."""
        if not self._there():
            return None
        if self.kind == "sqlite":
            schema, _, name = table.rpartition(".")
            at = f"{self.dialect.quoted(schema)}." if schema else ""
            found = self._ask(f"PRAGMA {at}table_info({self.dialect.quoted(name)})")
            columns = [ColumnSpec(n, self._type(t), not (strict or key), bool(key), None, None, t) for _, n, t, strict, _, key in found]
        else:
            columns = self._columns(table)
        return TableSpec(table, tuple(columns)) if columns else None

    def _columns(self, table: str) -> list[ColumnSpec]:
        where, values = self._where(table)
        kind = _TYPE[self.kind]
        found = self._ask(f"SELECT column_name, {kind}, is_nullable, numeric_precision, numeric_scale FROM information_schema.columns WHERE {where} ORDER BY ordinal_position", *values)
        own = where.replace("table_", "k.table_")
        keys = self._ask(
            "SELECT k.column_name FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name "
            f"AND c.table_schema = k.table_schema AND c.table_name = k.table_name WHERE c.constraint_type = 'PRIMARY KEY' AND {own}",
            *values,
        )
        primary = {r[0] for r in keys}
        return [ColumnSpec(n, self._type(t, p, s), null == "YES" and n not in primary, n in primary, None, None, t) for n, t, null, p, s in found]

    def _type(self, text: str, precision: int | None = None, scale: int | None = None) -> str:
        """Our type of a declared one, such as `decimal(12,2)`, `bigint unsigned` or `varchar(20)`."""
        if isinstance(text, bytes):
            text = text.decode()
        head, _, rest = text.lower().partition("(")
        inner, _, tail = rest.partition(")")
        sizes = [int(x) for x in inner.split(",") if x.strip().isdigit()]
        length, places = (sizes + [None, None])[:2]
        name = " ".join((head + tail).split())
        sized = (length if length is not None else precision, places if places is not None else scale)
        # SQLite's columns have any database's types.
        got = [d.type_of(name, *sized) for d in ((dbapi.POSTGRES, dbapi.MYSQL) if self.kind == "sqlite" else (self.dialect,))]
        return next((t for t in got if t != "string"), "string")
