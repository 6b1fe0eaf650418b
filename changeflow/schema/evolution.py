"""Schema changes as plain data, applied to specifications and to frames."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.model import ColumnSpec, TableSpec, spark_type
from changeflow.schema.dialects import MYSQL


class SchemaChangeError(ValueError):
    pass


class ColumnExists(SchemaChangeError):
    pass


class ColumnMissing(SchemaChangeError):
    pass


class CannotDropPrimaryKey(SchemaChangeError):
    pass


@dataclass(frozen=True)
class Change:
    """action: add, drop, rename or modify. position: the column's ordinal, for consumers that count columns."""

    action: str
    column: ColumnSpec | None = None
    name: str | None = None
    to: str | None = None
    position: int | None = None


def add(column: ColumnSpec, position: int | None = None) -> Change:
    return Change("add", column=column, position=position)


def drop(name: str, position: int | None = None) -> Change:
    return Change("drop", name=name, position=position)


def rename(name: str, to: str, position: int | None = None) -> Change:
    return Change("rename", name=name, to=to, position=position)


def modify(column: ColumnSpec, position: int | None = None) -> Change:
    return Change("modify", column=column, position=position)


def apply_change(spec: TableSpec, change: Change) -> TableSpec:
    """Added columns come last whatever their position; a key column can't be dropped, be it there or not."""
    columns = list(spec.columns)
    if change.action == "add":
        if spec.column(change.column.name):
            raise ColumnExists(change.column.name)
        return spec.with_columns([*columns, change.column])
    if change.action == "drop":
        if change.name in spec.primary_key:
            raise CannotDropPrimaryKey(change.name)
        if not spec.column(change.name):
            raise ColumnMissing(change.name)
        return spec.with_columns([c for c in columns if c.name != change.name])
    if change.action == "rename":
        if not spec.column(change.name):
            raise ColumnMissing(change.name)
        if change.to != change.name and spec.column(change.to):
            raise ColumnExists(change.to)
        return spec.with_columns([replace(c, name=change.to) if c.name == change.name else c for c in columns])
    if not spec.column(change.column.name):
        raise ColumnMissing(change.column.name)
    new = change.column
    return spec.with_columns([replace(c, type=new.type, nullable=new.nullable) if c.name == new.name else c for c in columns])


def apply_changes(spec: TableSpec, changes: list[Change]) -> TableSpec:
    """All changes in order; the first error ends it."""
    for change in changes:
        spec = apply_change(spec, change)
    return spec


def evolve(df: DataFrame, changes: list[Change]) -> DataFrame:
    """Rows of the old shape in the new one: added columns are null (or their default), modified ones are cast."""
    for c in changes:
        if c.action == "add":
            df = df.withColumn(c.column.name, F.lit(c.column.default).try_cast(spark_type(c.column.type)))
        elif c.action == "drop":
            df = df.drop(c.name)
        elif c.action == "rename":
            df = df.withColumnRenamed(c.name, c.to)
        else:
            df = df.withColumn(c.column.name, F.col(f"`{c.column.name}`").try_cast(spark_type(c.column.type)))
    return df


def positional(change: Change) -> Change:
    """The change in terms of `f0`, `f1`, ...; a rename becomes one to the same name. Without a position, as it is."""
    if change.position is None:
        return change
    name = f"f{change.position}"
    if change.action in ("add", "modify"):
        c = change.column
        return replace(change, column=ColumnSpec(name, c.type, c.nullable, c.primary_key, source_type=c.source_type or ""))
    return replace(change, name=name, to=name if change.action == "rename" else None)


def diff(old: list[ColumnSpec], new: list[ColumnSpec]) -> list[Change]:
    """Changes from old to new columns. One column gone and one come, of one type, and nothing else: a rename."""
    before, after = {c.name: c for c in old}, {c.name: c for c in new}
    same = lambda a, b: (a.type, a.nullable) == (b.type, b.nullable)
    come = [c for c in new if c.name not in before]
    gone = [c for c in old if c.name not in after]
    changed = [c for c in new if c.name in before and not same(before[c.name], c)]
    if len(come) == len(gone) == 1 and not changed and same(come[0], gone[0]):
        return [rename(gone[0].name, come[0].name)]
    at, was = {c.name: i for i, c in enumerate(new)}, {c.name: i for i, c in enumerate(old)}
    return [*[add(c, at[c.name]) for c in come], *[drop(c.name, was[c.name]) for c in gone], *[modify(c, at[c.name]) for c in changed]]


def watched(changes: list[Change], include: list[str] = (), exclude: list[str] = ()) -> list[Change]:
    """Changes of the columns that are listed (if any are) and not excluded."""
    name = lambda c: c.column.name if c.column else c.name
    return [c for c in changes if (not include or name(c) in include) and name(c) not in exclude]


_NAME = r"(?:`[^`]+`|[^\s`(),.]+)"
_COLUMN = re.compile(rf"\s*(?P<name>{_NAME})\s+(?P<type>[A-Za-z]+(?:\s+precision)?)\s*(?:\(\s*(?P<args>[^)]*)\))?(?P<rest>.*)$", re.S | re.I)
_NOT_COLUMNS = re.compile(r"(?:add\s+(?:index|key|constraint|primary|unique|foreign|fulltext|spatial|check)|drop\s+(?:index|key|primary|foreign|constraint|check))\b", re.I)
_HEAD = re.compile(rf"\s*alter\s+table\s+(?P<table>{_NAME}(?:\s*\.\s*{_NAME})?)\s+(?P<rest>.*?);?\s*$", re.I | re.S)


def _split(text: str) -> list[str]:
    """At commas outside parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def parse_column(text: str) -> ColumnSpec | None:
    m = _COLUMN.match(text)
    if not m:
        return None
    args = [a.strip() for a in (m["args"] or "").split(",")]
    number = lambda i: int(args[i]) if i < len(args) and args[i].isdigit() else None
    rest = m["rest"]
    kind = m["type"].lower() + (" unsigned" if re.search(r"\bunsigned\b", rest, re.I) else "")
    default = re.search(r"\bdefault\s+('(?:[^']|'')*'|[^\s,]+)", rest, re.I)
    comment = re.search(r"\bcomment\s+'((?:[^']|'')*)'", rest, re.I)
    value = default[1] if default else None
    return ColumnSpec(
        m["name"].strip("`"),
        MYSQL.type_of(kind, number(0), number(1)),
        nullable=not re.search(r"\bnot\s+null\b", rest, re.I),
        default=None if value is None or value.lower() == "null" else value.strip("'").replace("''", "'"),
        comment=comment[1].replace("''", "'") if comment else None,
        source_type=kind,
    )


def parse_alter(ddl: str) -> list[Change] | None:
    """The column changes of an ALTER TABLE statement (other clauses count for nothing); None for other statements.

    Lists in parentheses are split outside nested ones, so `DECIMAL(10,2)` stays whole in them."""
    head = _HEAD.match(ddl)
    if not head:
        return None
    out: list[Change] = []
    for action in _split(head["rest"]):
        if _NOT_COLUMNS.match(action):
            continue
        verb, _, rest = action.partition(" ")
        verb, rest = verb.lower(), re.sub(r"^\s*column\s+", "", rest, flags=re.I).strip()
        if verb == "add":
            texts = _split(rest[1:-1]) if rest.startswith("(") and rest.endswith(")") else [rest]
            out += [add(c) for c in map(parse_column, texts) if c]
        elif verb == "drop" and (m := re.match(_NAME, rest)):
            out.append(drop(m[0].strip("`")))
        elif verb == "modify" and (c := parse_column(rest)):
            out.append(modify(c))
        elif verb == "change" and (m := re.match(rf"({_NAME})\s+(.*)$", rest, re.S)) and (c := parse_column(m[2])):
            out += [rename(m[1].strip("`"), c.name), modify(c)]
        elif verb == "rename" and (m := re.match(rf"({_NAME})\s+to\s+({_NAME})", rest, re.I)) and re.match(r"rename\s+column\b", action, re.I):
            out.append(rename(m[1].strip("`"), m[2].strip("`")))
    return out


def altered_table(ddl: str) -> str | None:
    """The bare name of the table that an ALTER TABLE statement changes."""
    head = _HEAD.match(ddl)
    return re.split(r"\s*\.\s*", head["table"])[-1].strip("`") if head else None


class SchemaWatcher:
    """A table's columns as last seen: the first look is the initial schema, later ones give the changes since."""

    def __init__(self, include: list[str] = (), exclude: list[str] = ()):
        self.include, self.exclude, self.seen = include, exclude, {}

    def look(self, table: str, columns: list[ColumnSpec]) -> list[Change] | None:
        """None at first sight."""
        before, self.seen[table] = self.seen.get(table), columns
        return None if before is None else watched(diff(before, columns), self.include, self.exclude)

    def observe(self, table: str, ddl: str) -> list[Change]:
        changes = watched(parse_alter(ddl) or [], self.include, self.exclude)
        if table in self.seen:
            self.seen[table] = list(apply_changes(TableSpec(table, tuple(self.seen[table])), changes).columns)
        return changes
