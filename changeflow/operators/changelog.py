"""Applying change frames to tables, as each kind of sink does it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from changeflow.model import AFTER, BEFORE, DELETE, INSERT, data_columns


@dataclass(frozen=True)
class Policy:
    """Which kinds write a row and which remove one; the others are dropped. keyless: whether rows without a key append."""

    name: str
    upsert: tuple[str, ...] = (INSERT, AFTER)
    delete: tuple[str, ...] = ()
    keyless: bool = True


#: What sinks do with kinds.
JDBC = Policy("jdbc", delete=(DELETE,))
DOCUMENTS = Policy("documents", delete=(DELETE, BEFORE))  # search indexes
KEY_VALUE = Policy("key-value", delete=(DELETE, BEFORE), keyless=False)
APPEND = Policy("append")  # replacing merge trees: the last row of a key wins
POLICIES = {p.name: p for p in (JDBC, DOCUMENTS, KEY_VALUE, APPEND)}


def latest_by_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by `_seq`. A maximum, so each task sends one row for each key, however hot."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("_seq")).alias("_last"))
    return last.select(*[F.col(f"_last.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in changes.columns])


def effective(changes: DataFrame, policy: Policy) -> DataFrame:
    """changes with `_op`, `upsert` or `delete`; what the policy drops is gone."""
    op = F.when(F.col("_kind").isin(*policy.upsert), "upsert")
    if policy.delete:
        op = op.when(F.col("_kind").isin(*policy.delete), "delete")
    return changes.withColumn("_op", op).filter("_op is not null")


def apply_changelog(base: DataFrame | None, changes: DataFrame, keys: list[str], policy: Policy = JDBC) -> DataFrame:
    """The table after the changes, applied in order of `_seq`. Without keys, rows are appended and deletes have no effect."""
    names = data_columns(changes)
    acts = effective(changes, policy)
    if not keys:
        added = acts.filter("_op = 'upsert'").select(*names)
        return added if base is None else base.select(*names).unionByName(added)
    last = latest_by_key(acts, keys)
    now = last.filter("_op = 'upsert'").select(*names)
    if base is None:
        return now
    return base.select(*names).join(last.select(*keys), keys, "left_anti").unionByName(now)


def runs(changes: DataFrame, policy: Policy = JDBC, width: int | None = None) -> DataFrame:
    """changes with `_run`: a new one begins wherever writes turn to deletes or back, within a partition of `_origin`.

    Sinks that must keep the order of arrival send one statement per run. Turns are counted in buckets of `_seq`, whose edges
    and sums are handed on, so that a hot table is many tasks' work."""
    from pyspark.sql import Window

    from changeflow.operators.canal_client import BUCKET, neighbour

    width = width or BUCKET
    acts = neighbour(effective(changes, policy), F.col("_op"), False, width)
    acts = acts.withColumn("_turn", F.when(F.col("_op") != F.col("_near"), 1).otherwise(0)).withColumn("_bucket", F.floor(F.col("_seq") / width)).drop("_near")
    across = Window.partitionBy("_origin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = acts.groupBy("_origin", "_bucket").agg(F.sum("_turn").alias("_sum"))
    ahead = sums.select(F.col("_origin").alias("_o"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_origin", "_bucket").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    met = acts.withColumn("_run", F.sum("_turn").over(inside)).join(ahead, F.col("_origin").eqNullSafe(F.col("_o")) & (F.col("_bucket") == F.col("_b")))
    return met.withColumn("_run", (F.col("_run") + F.col("_ahead")).cast("bigint")).drop("_turn", "_bucket", "_o", "_b", "_ahead")


def document_id(df: DataFrame, keys: list[str], delimiter: str = "_") -> Column:
    """Keys joined to an id; null if there are none or one of them is null."""
    from changeflow.functions.display import display

    if not keys:
        return F.lit(None).cast("string")
    # concat, unlike concat_ws, is null as soon as one part is.
    parts = [x for k in keys for x in (F.lit(delimiter), display(F.col(f"`{k}`"), df.schema[k].dataType))][1:]
    return F.concat(*parts)


def bulk_lines(changes: DataFrame, keys: list[str], index: str, enable_delete: bool = True, delimiter: str = "_") -> DataFrame:
    """`_seq` and `lines`: the newline-delimited actions of a bulk request. Rows without an id are indexed, never deleted."""
    from changeflow.functions.display import json_object, json_value
    from changeflow.functions.scalars import template

    names = data_columns(changes)
    values = {f"f{i}": F.col(f"`{n}`") for i, n in enumerate(names)} | {"table_name": F.element_at(F.split("_origin", r"\."), -1)}
    quoted = lambda x: json_value(x, StringType())
    doc = json_object({n: json_value(F.col(f"`{n}`"), changes.schema[n].dataType, "0x") for n in names})
    at = {"_index": quoted(template(index, values))}
    ident = document_id(changes, keys, delimiter)
    with_id = json_object(at | {"_id": quoted(ident)})
    put = F.when(ident.isNull(), F.concat(F.lit('{"index":'), json_object(at), F.lit("}\n"), doc, F.lit("\n"))).otherwise(
        F.concat(F.lit('{"update":'), with_id, F.lit('}\n{"doc":'), doc, F.lit(',"doc_as_upsert":true}\n'))
    )
    lines = F.when(F.col("_kind").isin(INSERT, AFTER), put)
    if enable_delete:
        lines = lines.when(ident.isNotNull(), F.concat(F.lit('{"delete":'), with_id, F.lit("}\n")))
    return changes.select("_seq", lines.alias("lines")).filter("lines is not null")


def redis_commands(changes: DataFrame, data_type: str = "string", key: str = "${f0}", field: str = "${f1}", value: str | None = None) -> DataFrame:
    """`_seq`, `command`, `key`, `field`, `value` of a key-value store's commands for each row."""
    from changeflow.functions.display import json_object, json_value
    from changeflow.functions.scalars import template
    from changeflow.model import insert_like

    names = data_columns(changes)
    values = {f"f{i}": F.col(f"`{n}`") for i, n in enumerate(names)}
    add = {"string": "SET", "hash": "HSET", "list": "LPUSH", "set": "SADD", "zset": "ZADD"}[data_type]
    remove = {"string": "DEL", "hash": "HDEL", "list": "LREM", "set": "SREM", "zset": "ZREM"}[data_type]
    whole = json_object({f"f{i}": json_value(F.col(f"`{n}`"), changes.schema[n].dataType, "0x") for i, n in enumerate(names)})
    return changes.select(
        "_seq",
        F.when(insert_like(F.col("_kind")), add).otherwise(remove).alias("command"),
        template(key, values).alias("key"),
        (template(field, values) if data_type == "hash" else F.lit(None).cast("string")).alias("field"),
        (template(value, values) if value else whole).alias("value"),
    )


def json_each_row(changes: DataFrame) -> DataFrame:
    """`_seq` and `line`: rows that a column store takes, named objects; deletes and before images are skipped.

    Bytes are hex, decimals text, times `yyyy-MM-dd HH:mm:ss` (with milliseconds where a zone is known)."""
    from pyspark.sql import types as T

    from changeflow.functions.display import json_object, json_value

    def shown(name: str) -> Column:
        x, kind = F.col(f"`{name}`"), changes.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            x, kind = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSS" if isinstance(kind, T.TimestampType) else "yyyy-MM-dd HH:mm:ss"), T.StringType()
        return json_value(x, kind, "hex")

    line = json_object({n: shown(n) for n in data_columns(changes)})
    return changes.filter(F.col("_kind").isin(INSERT, AFTER)).select("_seq", line.alias("line"))
