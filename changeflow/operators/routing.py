"""Which rows are taken, and where they go: table selection, topics, keys, payloads. Column expressions over `_origin`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.display import display, json_array, json_value
from changeflow.model import data_columns


@dataclass(frozen=True)
class TableSelector:
    """Databases by name or (whole-name) pattern, tables by `db.table` or by patterns found anywhere in `db.table`.

    If any table is selected, tables decide and the list of database names only narrows them; otherwise databases decide."""

    databases: tuple[str, ...] = ()
    database_pattern: str | None = None
    tables: tuple[str, ...] = ()
    table_patterns: tuple[str, ...] = ()

    @classmethod
    def legacy(cls, database: str, table: str) -> TableSelector:
        """Single names in which a final `%` stands for anything."""
        if not database and not table:
            return cls()
        more = {"database_pattern": re.escape(database[:-1]) + ".*"} if database.endswith("%") else {"databases": (database,)}
        if table.endswith("%"):
            return cls(**more, table_patterns=(rf"^.*\.{re.escape(table[:-1])}.*$",))
        return cls(**more, tables=(f"{database}.{table}",))

    def matches(self, origin: Column) -> Column:
        database = F.regexp_extract(origin, r"^(?:(.*)\.)?[^.]*$", 1)
        in_database = F.lit(False)
        if self.databases:
            in_database = in_database | database.isin(*self.databases)
        if self.database_pattern:
            in_database = in_database | F.rlike(database, F.lit(f"^(?:{self.database_pattern})$"))
        if not self.tables and not self.table_patterns:
            return F.coalesce(in_database, F.lit(False))
        hit = F.lit(False)
        if self.tables:
            hit = hit | origin.isin(*self.tables)
        for p in self.table_patterns:
            hit = hit | F.rlike(origin, F.lit(p))
        return F.coalesce(hit & in_database if self.databases else hit, F.lit(False))


def select_tables(df: DataFrame, selector: TableSelector) -> DataFrame:
    return df.filter(selector.matches(F.col("_origin")))


def _rendered(topic: str, origin: Column) -> Column:
    if "${table}" not in topic and "${database}" not in topic:
        return F.lit(topic)
    database, table = F.regexp_extract(origin, r"^(.*)\.[^.]*$", 1), F.regexp_extract(origin, r"([^.]*)$", 1)
    text = F.replace(F.replace(F.lit(topic), F.lit("${database}"), database), F.lit("${table}"), table)
    missing = origin.isNull() | (database == "") | (table == "")
    return F.when(missing, F.raise_error(F.concat(F.lit(f"topic {topic} needs database and table; the row's origin is "), F.coalesce(origin, F.lit("null")))).cast("string")).otherwise(text)


def route_topics(origin: Column, default: str, routes: list[tuple[str, str]] = ()) -> Column:
    """An array of topics: of all routes (pattern of the whole origin, topic) that match, in order, without repeats; else the default."""
    for pattern, _ in routes:
        re.compile(pattern)  # a pattern that is none fails when the job is planned
    found = F.array_compact(F.array(*[F.when(F.rlike(origin, F.lit(f"^(?s:{p})$")), _rendered(t, origin)) for p, t in routes])) if routes else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(_rendered(default, origin)))


def fan_out_topics(df: DataFrame, default: str, routes: list[tuple[str, str]] = ()) -> DataFrame:
    """One copy of each row for each of its topics, in column `topic`."""
    return df.withColumn("topic", F.explode(route_topics(F.col("_origin"), default, routes)))


def row_key(df: DataFrame, selectors: list[str]) -> Column:
    """`#n` or `fn` selectors' values joined by `_`, null and unknown ones empty; an empty key without selectors."""
    if not selectors:
        return F.lit("")
    own, parts = data_columns(df), []
    for s in selectors:
        number = s[1:] if s[:1] in ("#", "f") else ""
        i = int(number) if number.isdigit() else -1
        parts.append(F.coalesce(display(F.col(f"`{own[i]}`"), df.schema[own[i]].dataType), F.lit("")) if 0 <= i < len(own) else F.lit(""))
    return F.concat_ws("_", *parts)


def payload(df: DataFrame, fmt: str = "json", delimiter: str = ",") -> Column:
    """A queue's message: delimited text, or a positional JSON array for every other format; a NaN is 0 there."""
    from changeflow.codecs.text import joined

    own = data_columns(df)
    if fmt.lower() == "text":
        return joined(df, own, delimiter)
    out = []
    for n in own:
        x, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
        out.append(json_value(x, kind, "base64"))
    return json_array(out)


def messages(df: DataFrame, topic: str, routes: list[tuple[str, str]] = (), keys: list[str] = (), fmt: str = "json", delimiter: str = ",") -> DataFrame:
    """key, value, topic: what a queue's writer takes."""
    made = df.select("_origin", row_key(df, list(keys)).alias("key"), payload(df, fmt, delimiter).alias("value"))
    return fan_out_topics(made, topic, routes).select("key", "value", "topic")


def console_lines(df: DataFrame, prefix: str = "[console] ") -> DataFrame:
    """`line`: the row as an object of f0 to fN."""
    from changeflow.functions.display import json_object

    own = data_columns(df)
    # Keys stand in alphabetical order: f0, f1, f10, f2.
    body = json_object({f"f{i}": json_value(F.col(f"`{n}`"), df.schema[n].dataType, "0x") for i, n in enumerate(own)})
    return df.select(F.concat(F.lit(prefix), body).alias("line"))
