"""A database sink over Python's DB-API: statements of a dialect, sent per partition by executors, and applied DDL.

Changes are reduced to the last one of each key first, and each key is sent by one task, so a task that is run again
writes the same rows. Rows without a key are inserted, and twice if their task is run twice."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.model import TableSpec, align
from changeflow.operators.changelog import JDBC, effective, latest_by_key
from changeflow.schema.dialects import MYSQL, POSTGRES, Dialect

#: Modules that are tried for each kind of database, and the mark of their parameters.
MODULES = {"mysql": (("pymysql", "MySQLdb"), "%s"), "postgresql": (("psycopg2", "psycopg"), "%s"), "sqlite": (("sqlite3",), "?")}


def kind_of(url: str) -> str:
    found = re.match(r"(?:jdbc:)?(mysql|tidb|postgresql|postgres|sqlite):", url)
    if not found:
        raise ValueError(f"no database sink for {url!r}")
    return {"tidb": "mysql", "postgres": "postgresql"}.get(found[1], found[1])


def dialect_of(url: str) -> Dialect:
    return MYSQL if kind_of(url) == "mysql" else POSTGRES


def connect(url: str, user: str | None = None, password: str | None = None):
    """A connection, on whichever machine this is called."""
    kind = kind_of(url)
    for name in MODULES[kind][0]:
        try:
            module = importlib.import_module(name)
        except ModuleNotFoundError:
            continue
        if kind == "sqlite":
            return module.connect(url.split(":", 2)[-1] if url.startswith("jdbc:") else url.split(":", 1)[1], timeout=60)
        at = urlparse(url.removeprefix("jdbc:"))
        named = {"host": at.hostname, "port": at.port, "user": user or at.username, "password": password or at.password}
        named["dbname" if kind == "postgresql" else "database"] = at.path.lstrip("/")
        return module.connect(**{k: v for k, v in named.items() if v is not None})
    raise ValueError(f"a {kind} sink needs one of the packages {', '.join(MODULES[kind][0])}")


def native(sql: str, kind: str) -> str:
    """A statement with a driver's own parameter marks; without casts where the database has none."""
    mark = MODULES[kind][1]
    if kind == "mysql":
        return sql.replace("?", mark)
    return re.sub(r"\$\d+(::[a-z ]+(?=[,)]|$| AND))?", lambda m: mark + (m[1] or "" if kind == "postgresql" else ""), sql)


def execute(url: str, statements: list[str], **who) -> None:
    """DDL and the like, from the driver."""
    con = connect(url, **who)
    try:
        cursor = con.cursor()
        for sql in statements:
            cursor.execute(native(sql, kind_of(url)))
        con.commit()
    finally:
        con.close()


def apply_schema(url: str, table: str, changes: list, **who) -> None:
    """Schema changes, applied to the database's own table."""
    execute(url, [sql for c in changes for sql in dialect_of(url).change(table, c)], **who)


def open_table(url: str, spec: TableSpec, schema_mode: str = "CREATE_SCHEMA_WHEN_NOT_EXIST", data_mode: str = "APPEND_DATA", custom: str | None = None, **who) -> None:
    """Save modes. custom: the statement of CUSTOM_PROCESSING."""
    dialect = dialect_of(url)
    table, create = dialect.table(spec.identifier), dialect.create_table(spec)

    def ask(sql: str) -> list | None:
        con = connect(url, **who)
        try:
            cursor = con.cursor()
            cursor.execute(sql)
            return cursor.fetchall()
        except Exception:
            return None
        finally:
            con.close()

    there = ask(f"SELECT 1 FROM {table} WHERE 1 = 0") is not None
    if schema_mode == "ERROR_WHEN_SCHEMA_NOT_EXIST" and not there:
        raise ValueError(f"the table {spec.identifier} does not exist")
    if schema_mode == "RECREATE_SCHEMA":
        execute(url, [f"DROP TABLE IF EXISTS {table}", create], **who)
    elif schema_mode == "CREATE_SCHEMA_WHEN_NOT_EXIST" and not there:
        execute(url, [create], **who)
    if data_mode == "DROP_DATA" and there:
        execute(url, [f"DELETE FROM {table}"], **who)
    elif data_mode == "ERROR_WHEN_DATA_EXISTS" and there and ask(f"SELECT 1 FROM {table} LIMIT 1"):
        raise ValueError(f"the table {spec.identifier} has rows")
    elif data_mode == "CUSTOM_PROCESSING" and custom:
        execute(url, [custom], **who)


def write(changes: DataFrame, spec: TableSpec, url: str, batch_size: int = 1000, connections: int = 8, opened: Callable | None = None, **who) -> None:
    """Sends the changes. connections: how many tasks write at once. opened: makes a connection, in place of connect()."""
    dialect, kind, keys = dialect_of(url), kind_of(url), spec.primary_key
    columns, names = list(spec.columns), spec.names
    put = native(dialect.upsert(spec.identifier, columns, keys) if keys else dialect.insert(spec.identifier, columns), kind)
    remove = native(dialect.delete(spec.identifier, [c for c in columns if c.primary_key]), kind) if keys else None
    changes = align(changes, spec)
    acts = effective(latest_by_key(changes, keys) if keys else changes, JDBC).select("_op", *names)
    acts = acts.repartition(connections, *keys) if keys else acts.coalesce(connections)
    plain = [c for c, t in acts.dtypes if t.startswith(("timestamp", "date", "decimal"))] if kind == "sqlite" else []
    acts = acts.withColumns({c: F.col(f"`{c}`").cast("string") for c in plain})

    def send(rows: Iterator) -> None:
        con = None
        held: dict[str, list[tuple]] = {"upsert": [], "delete": []}

        def flush(op: str) -> None:
            if held[op]:
                con.cursor().executemany(put if op == "upsert" else remove, held[op])
                con.commit()
                held[op] = []

        try:
            for row in rows:
                con = con or (opened() if opened else connect(url, **who))
                if row["_op"] == "upsert":
                    held["upsert"].append(tuple(row[c] for c in names))
                elif remove:
                    held["delete"].append(tuple(row[k] for k in keys))
                if len(held[row["_op"]]) >= batch_size:
                    flush(row["_op"])
            if con:
                flush("upsert")
                flush("delete")
        finally:
            if con:
                con.close()

    acts.foreachPartition(send)
