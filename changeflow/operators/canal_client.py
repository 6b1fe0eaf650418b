"""The canal-client message encoder: before and after images of an update become one message.

An after image belongs to the before image that precedes it among its table's update images; inserts and deletes in
between don't matter. Order within a table is found in buckets of `_seq`, whose last rows are handed on to the next
bucket, so a table that holds a third of all changes is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.display import display, json_object, json_value
from changeflow.model import AFTER, BEFORE, DELETE, INSERT, data_columns

BUCKET = 100_000


@dataclass(frozen=True)
class Fields:
    """key: the column of the message key; must, update: database column to message field."""

    key: str
    must: dict[str, str]
    update: dict[str, str] = field(default_factory=dict)


#: The envelope's keys in both styles.
ENVELOPE = {"camel": ("requestId", "dbName", "tableName", "eventType", "oldData"), "snake": ("request_id", "db_name", "table_name", "event_type", "old_data")}


def key_naming(style: str) -> str:
    low = style.strip().lower().replace("-", "").replace("_", "")
    return "snake" if low in ("snake", "snakecase") else "camel"


def value_json(x: Column, kind: T.DataType, zone: str = "UTC") -> Column:
    """JSON text of a value: strict datetimes are epoch milliseconds in the zone, plain numbers in text are numbers."""
    quoted = lambda c: json_value(c, T.StringType())
    millis = lambda t: F.unix_millis(F.to_utc_timestamp(t, zone)).cast("string")
    if isinstance(kind, T.StringType):
        dated = F.when(F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")))
        number = F.when(F.rlike(x, F.lit(r"^(?:0|[1-9][0-9]*)$")), x.try_cast("bigint").cast("string"))
        out = F.coalesce(millis(dated), number, quoted(x))
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        out = millis(x.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        out = F.unix_millis(x).cast("string")
    elif isinstance(kind, T.DecimalType):
        out = quoted(x.cast("string"))
    else:
        out = json_value(x, kind, "hex")
    return F.coalesce(out, F.lit("null"))


def neighbour(df: DataFrame, value: Column, forward: bool, width: int) -> DataFrame:
    """df with `_near`: value of the row before (or after) in the order of `_seq` within `_origin`."""
    df = df.withColumn("_bucket", F.floor(F.col("_seq") / width)).withColumn("_value", value)
    inside = Window.partitionBy("_origin", "_bucket").orderBy("_seq")
    edge = F.min_by if forward else F.max_by
    ends = df.groupBy("_origin", "_bucket").agg(edge("_value", "_seq").alias("_end"))
    across = Window.partitionBy("_origin").orderBy("_bucket")
    move = F.lead if forward else F.lag
    ends = ends.select(F.col("_origin").alias("_o"), F.col("_bucket").alias("_b"), move("_end").over(across).alias("_edge"))
    own = df.withColumn("_inside", move("_value").over(inside))
    met = own.join(ends, F.col("_origin").eqNullSafe(F.col("_o")) & (F.col("_bucket") == F.col("_b")), "left")
    return met.withColumn("_near", F.coalesce("_inside", "_edge")).drop("_bucket", "_value", "_inside", "_edge", "_o", "_b")


def pair_updates(changes: DataFrame, width: int = BUCKET) -> DataFrame:
    """changes with `_event` (insert, update, delete) and `_old`, the before image as a struct; before images that have
    their after image are gone, others have become deletes."""
    image = F.struct(*[F.col(f"`{c}`") for c in data_columns(changes)])
    updates = changes.filter(F.col("_kind").isin(BEFORE, AFTER))
    tagged = F.struct(F.col("_kind").alias("kind"), image.alias("image"))
    back = neighbour(updates, tagged, False, width).withColumn("_old", F.when((F.col("_kind") == AFTER) & (F.col("_near.kind") == BEFORE), F.col("_near.image"))).drop("_near")
    both = neighbour(back, F.col("_kind"), True, width)
    lone = ~((F.col("_kind") == BEFORE) & F.coalesce(F.col("_near") == AFTER, F.lit(False)))
    updates = both.filter(lone).withColumn("_event", F.when(F.col("_kind") == BEFORE, "delete").otherwise("update")).drop("_near")
    rest = changes.filter(F.col("_kind").isin(INSERT, DELETE))
    rest = rest.withColumn("_old", F.lit(None).cast(updates.schema["_old"].dataType)).withColumn("_event", F.when(F.col("_kind") == INSERT, "insert").otherwise("delete"))
    return updates.unionByName(rest)


def _object(pairs: list[tuple[str, Column, Column]]) -> Column:
    """An object of the fields whose condition holds."""
    import json

    parts = [F.when(ok, F.concat(F.lit(json.dumps(k) + ":"), v)) for k, v, ok in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def encode(changes: DataFrame, fields: Fields, zone: str = "UTC", naming: str = "camel", width: int = BUCKET, request_id: Column | None = None) -> DataFrame:
    """`_origin`, `_seq`, `key`, `payload`. Updates that change no configured column are left out if `update` is given.

    One table's fields; for several tables, encode each one's rows and union them."""
    own = {c: changes.schema[c].dataType for c in data_columns(changes)}
    unknown = [c for c in (fields.key, *fields.must, *fields.update) if c not in own]
    if unknown:
        raise ValueError(f"canal-client fields name unknown columns: {', '.join(unknown)}")
    paired = pair_updates(changes, width)
    new = lambda c: value_json(F.col(f"`{c}`"), own[c], zone)
    old = lambda c: value_json(F.col(f"_old.`{c}`"), own[c], zone)
    have_old, always = F.col("_old").isNotNull(), F.lit(True)
    changed = {c: have_old & (new(c) != old(c)) for c in (*fields.must, *fields.update)}
    must = [(t, new(c), always) for c, t in fields.must.items()]
    more = [(t, new(c), (F.col("_event") != "delete") & (~have_old | changed[c])) for c, t in fields.update.items()]
    before = _object([(t, old(c), always) for c, t in (*fields.must.items(), *fields.update.items())])
    ident, db, table, event, old_data = ENVELOPE[key_naming(naming)]
    database, name = F.regexp_extract("_origin", r"^(.*)\.[^.]*$", 1), F.regexp_extract("_origin", r"([^.]*)$", 1)
    text = lambda x: json_value(x, T.StringType())
    unique = request_id if request_id is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    envelope = {ident: text(unique), db: text(database), table: text(name), event: text(F.col("_event")), "data": _object(must + more)}
    message = F.when(have_old, json_object(envelope | {old_data: before})).otherwise(json_object(envelope))
    if fields.update:
        any_change = F.lit(False)
        for c in changed.values():
            any_change = any_change | c
        paired = paired.filter(~have_old | any_change)
    return paired.select("_origin", "_seq", F.coalesce(display(F.col(f"`{fields.key}`"), own[fields.key]), F.lit("")).alias("key"), message.alias("payload"))


def encode_tables(changes: DataFrame, registry: dict[str, Fields], zone: str = "UTC", naming: str = "camel", width: int = BUCKET, request_id: Column | None = None) -> DataFrame:
    """encode() for several tables, each with the fields that are registered for its origin. A row of any other origin, or of
    none, fails the job: it was never registered, so nobody knows its fields."""
    if not registry:
        raise ValueError("no table is registered")
    foreign = ~F.coalesce(F.col("_origin").isin(*registry), F.lit(False))
    told = F.concat(F.lit("a row of "), F.coalesce("_origin", F.lit("no table")), F.lit(", which is not registered"))
    known = changes.withColumn("_origin", F.when(foreign, F.raise_error(told).cast("string")).otherwise(F.col("_origin")))
    parts = [encode(known.filter(F.col("_origin") == origin), fields, zone, naming, width, request_id) for origin, fields in registry.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
