"""Change streams that arrive as messages (queue topics, files): snapshot, start, stop, hand-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow import codecs
from changeflow.model import BEFORE, INSERT, TableSpec

#: Modes and their aliases.
STARTUP = {"initial": "initial", "snapshot": "snapshot", "snapshot-only": "snapshot", "earliest": "earliest", "latest": "latest", "timestamp": "timestamp", "specific": "specific", "specific-offset": "specific"}
STOP = {"never": "never", "latest": "latest", "timestamp": "timestamp", "specific": "specific"}


def start_at(changes: DataFrame, mode: str = "initial", ts: str = "ts", boundary: Column | None = None, seq: int | None = None) -> DataFrame:
    """timestamp: rows before the boundary go; specific: rows up to `seq` go; latest: none of a bounded frame stay."""
    mode = STARTUP[mode.lower()]
    if mode == "timestamp":
        return changes.filter(F.col(ts) >= boundary)
    if mode == "specific":
        return changes.filter(F.col("_seq") > seq)
    return changes.filter(F.lit(False)) if mode in ("latest", "snapshot") else changes


def stop_at(changes: DataFrame, mode: str = "never", ts: str = "ts", boundary: Column | None = None, seq: int | None = None) -> DataFrame:
    """timestamp and specific: the first event beyond the boundary ends the stream, so everything from it on goes.

    One minimum over the events beyond finds it; it is attached as a scalar, not collected."""
    mode = STOP[mode.lower()]
    if mode in ("never", "latest"):
        return changes
    beyond = F.col(ts) > boundary if mode == "timestamp" else F.col("_seq") > seq
    first = changes.agg(F.min(F.when(beyond, F.col("_seq"))).alias("_stop"))
    return changes.join(F.broadcast(first), F.lit(True)).filter(F.col("_stop").isNull() | (F.col("_seq") < F.col("_stop"))).drop("_stop")


def hand_over(snapshot: DataFrame, stream: DataFrame, keys: list[str], high: int | None = None) -> DataFrame:
    """Snapshot rows as inserts, then the stream's changes. Events at or below the snapshot's high mark are already in it;
    with the mark known nothing can occur twice, and nothing is shuffled."""
    if high is not None:
        return snapshot.unionByName(stream.filter(F.col("_seq") > high), allowMissingColumns=True)
    return snapshot.unionByName(stream, allowMissingColumns=True).dropDuplicates([*keys, "_seq", "_kind"])


def retention_gap(oldest: int | None, boundary: int, policy: str = "fail") -> bool:
    """Whether history before the oldest event is missing for a boundary; policy fail raises."""
    gap = oldest is not None and oldest > boundary
    if gap and policy == "fail":
        raise ValueError(f"history begins at {oldest}, after the requested {boundary}")
    return gap


def single_image(changes: DataFrame) -> DataFrame:
    """Sources that have no image before an update: before images go."""
    return changes.filter(F.col("_kind") != BEFORE)


def put_or_insert(kind: Column, old_value: Column) -> Column:
    """A put with an old value is an update."""
    return F.when((kind == "PUT") & old_value.isNotNull(), "UPDATE_AFTER").when(kind == "PUT", INSERT).otherwise("DELETE")


def read_messages(df: DataFrame, column: str, spec: TableSpec | None, fmt: str = "json") -> DataFrame:
    """A queue's messages as changes. Without a table: text is one column f0; JSON goes by position, see `positional`."""
    if spec is not None:
        return codecs.decode(df, column, spec, fmt)
    return positional(df, column) if fmt.lower() != "text" else df.select(F.col(column).cast("string").alias("f0"), F.lit(INSERT).alias("_kind"))


def positional(df: DataFrame, column: str, keep: tuple[str, ...] = ("_origin", "_seq")) -> DataFrame:
    """`fields`: an array of variant texts: an object's values in order of its keys, an array's elements, or the whole text."""
    v = F.try_parse_json(F.col(column).cast("string"))
    kind = F.schema_of_variant(v)
    pairs = F.array_sort(F.map_entries(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.try_variant_get(x, "$", "string"))))
    values = F.transform(pairs, lambda e: e["value"])
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    fields = F.when(F.startswith(kind, F.lit("OBJECT")), values).when(F.startswith(kind, F.lit("ARRAY")), items).otherwise(F.array(F.col(column).cast("string")))
    return df.select(fields.alias("fields"), F.lit(INSERT).alias("_kind"), *[c for c in keep if c in df.columns])


def drill(df: DataFrame, column: str, path: str = "") -> DataFrame:
    """Response bodies to rows of `fields`: a dotted path is followed first; an array gives a row per element."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    v = F.try_variant_get(F.try_parse_json(F.col(column)), f"${steps}", "variant")
    kind = F.schema_of_variant(v)
    each = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    texts = df.select(F.explode(each).alias("v")).select(F.when(F.rlike(F.schema_of_variant("v"), F.lit("^(?:OBJECT|ARRAY)")), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("body"))
    return positional(texts, "body")


def key_value_rows(df: DataFrame) -> DataFrame:
    """A key-value store's keys as rows of `fields`. df: key, type and value, which is a string, a map (hash), an array
    (list, set) or a map of scores (zset) in the columns text, map, items, scores. Hashes and sets go in order."""
    one = F.array(F.array("key", "text"))
    pairs = F.transform(F.array_sort(F.map_entries("map")), lambda e: F.array(F.col("key"), e["key"], e["value"]))
    listed = F.transform("items", lambda v: F.array(F.col("key"), v))
    members = F.transform(F.array_sort("items"), lambda v: F.array(F.col("key"), v))
    scored = F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.array(F.col("key"), e["key"], e["value"].cast("string")))
    rows = F.when(F.col("type") == "string", one).when(F.col("type") == "hash", pairs).when(F.col("type") == "list", listed).when(F.col("type") == "set", members).when(F.col("type") == "zset", scored)
    return df.select(F.explode(rows).alias("fields"), F.lit(INSERT).alias("_kind"))


def search_rows(df: DataFrame, ident: str = "_id", source: str = "_source") -> DataFrame:
    """A search index's hits as rows of `fields`: the id, then the document's values in order of their names."""
    got = positional(df.withColumn("_hit", F.col(ident)).select("_hit", F.col(source).alias("_doc")), "_doc", keep=("_hit",))
    return got.select(F.concat(F.array("_hit"), "fields").alias("fields"), "_kind")


#: Where messages say which table they are of, and when.
_DATABASES, _TABLES, _TIMES = ("$.source.db", "$.database", "$._db", "$.db"), ("$.source.table", "$.table", "$._table"), ("$.ts_ms", "$.source.ts_ms", "$.ts", "$.es")


def change_messages(messages: DataFrame, spec: TableSpec, fmt: str, column: str = "value", selector=None, startup: str = "initial", stop: str = "never", start_ms: int | None = None, stop_ms: int | None = None, seq: int | None = None, stop_seq: int | None = None, updates: str = "both") -> DataFrame:
    """A change source that is fed by messages (of a topic or of files), one format and one table's columns.

    `_origin` and `ts_ms` are what the message says; a column `offset` of the input is `_seq`. startup and stop as in
    start_at and stop_at. updates: `after` for sources without an image before."""
    text = F.col(column).cast("string")
    said = lambda paths: F.coalesce(*[F.get_json_object(text, p) for p in paths])
    database, table = said(_DATABASES), said(_TABLES)
    order = F.col("offset").cast("bigint") if "offset" in messages.columns else F.monotonically_increasing_id()
    told = messages.select(text.alias("_message"), order.alias("_seq"), F.when(table.isNotNull(), F.concat_ws(".", database, table)).alias("_origin"), said(_TIMES).cast("bigint").alias("_ms"))
    if selector is not None:
        told = told.filter(selector.matches(F.col("_origin")))
    told = start_at(told, startup, "_ms", None if start_ms is None else F.lit(start_ms), seq)
    told = stop_at(told, stop, "_ms", None if stop_ms is None else F.lit(stop_ms), stop_seq)
    got = codecs.decode(told, "_message", spec, fmt)
    return single_image(got) if updates == "after" else got
