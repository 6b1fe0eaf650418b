"""JSON formats of change messages as expressions over VARIANT: a message is parsed once, in the JVM.

Decoders share one shape: a list of (kind, image) per message, an image being a map of the table's columns, exploded to
rows; nothing is shuffled. What a message says about a column is read with the column's declared type; a value that
doesn't fit it is null. Messages that don't parse to an object are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.display import json_array, json_object, json_value
from changeflow.model import AFTER, BEFORE, DELETE, INSERT, META, TableSpec, data_columns, spark_type

_MAP = "map<string,variant>"


def _parsed(df: DataFrame, column: str) -> DataFrame:
    """`_v`: the message. Metadata that isn't there yet is added."""
    got = df.withColumn("_v", F.try_parse_json(F.col(column).cast("string")))
    if "_origin" not in df.columns:
        got = got.withColumn("_origin", F.lit(None).cast("string"))
    return got if "_seq" in df.columns else got.withColumn("_seq", F.monotonically_increasing_id())


def _at(path: str) -> Column:
    return F.try_variant_get("_v", path, _MAP)


def _text(path: str) -> Column:
    """A string at a path; null for other types."""
    v = F.try_variant_get("_v", path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _value(image: Column, name: str, kind: str, nested: bool = True) -> Column:
    v = F.try_element_at(image, F.lit(name))
    got = F.try_variant_get(v, "$", kind)
    if kind == "double":
        got = F.coalesce(got, F.try_variant_get(v, "$", "bigint").cast("double"))
    return got if nested else F.when(~F.rlike(F.schema_of_variant(v), F.lit("^(?:OBJECT|ARRAY)")), got)


def _images(df: DataFrame, spec: TableSpec, rows: list[tuple[Column | None, str, Column]], nested: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """rows: (condition or None, kind, image); of each message those whose condition holds, in this order. Messages that are
    no JSON objects go after the explosion, an outer one: a filter before it, or one that is inferred, would parse again."""
    parts = []
    for when, kind, image in rows:
        one = F.struct(F.lit(kind).alias("_kind"), image.alias("_image"))
        parts.append(one if when is None else F.when(when, one))
    out = df.select(*[c for c in META if c != "_kind"], F.posexplode_outer(F.when(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.array_compact(F.array(*parts)))).alias("_turn", "_row")).filter("_row is not null")
    data = [_value(F.col("_row._image"), c.name, (types or {}).get(c.name, spark_type(c.type)), nested).alias(c.name) for c in spec.columns]
    return out.select(*data, F.col("_row._kind").alias("_kind"), "_origin", "_seq", "_turn")


def _or_empty(image: Column) -> Column:
    return F.coalesce(image, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def decode_json(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """An object by column names."""
    return _images(_parsed(df, column), spec, [(None, INSERT, _or_empty(_at("$")))])


def decode_native(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """As json, but nested values are null and numbers with a fraction are text, whatever type is declared."""
    texts = {c.name: "string" for c in spec.columns if c.type in ("float", "double") or c.type.startswith("decimal")}
    return _images(_parsed(df, column), spec, [(None, INSERT, _or_empty(_at("$")))], nested=False, types=texts)


def decode_connect(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """The `payload` object; without one, all columns are null."""
    return _images(_parsed(df, column), spec, [(None, INSERT, _or_empty(_at("$.payload")))], nested=False)


def decode_canal(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """`_type`, `data[0]`, `old[0]`. What an update's `old` doesn't name is null in the image before."""
    kind = F.coalesce(_text("$._type"), F.lit("INSERT"))
    data, old = _or_empty(_at("$.data[0]")), _or_empty(_at("$.old[0]"))
    rows = [(kind == "UPDATE", BEFORE, old), (kind == "UPDATE", AFTER, data), (kind == "DELETE", DELETE, data), (~kind.isin("UPDATE", "DELETE"), INSERT, data)]
    return _images(_parsed(df, column), spec, rows)


def decode_maxwell(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    kind = F.coalesce(_text("$.type"), F.lit("insert"))
    data, old = _or_empty(_at("$.data")), _or_empty(_at("$.old"))
    rows = [(kind == "update", BEFORE, old), (kind == "update", AFTER, data), (kind == "delete", DELETE, data), (~kind.isin("update", "delete"), INSERT, data)]
    return _images(_parsed(df, column), spec, rows, nested=False)


def decode_debezium(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """`op`, `before`, `after`. A column that one image lacks is taken from the other; one that is null there stays null."""
    op = F.coalesce(_text("$.op"), F.lit("c"))
    before, after = _or_empty(_at("$.before")), _or_empty(_at("$.after"))
    lacking = lambda image, other: F.map_concat(image, F.map_filter(other, lambda k, _: ~F.map_contains_key(image, k)))
    old, new = lacking(before, after), lacking(after, before)
    rows = [(op == "u", BEFORE, old), (op == "u", AFTER, new), (op == "d", DELETE, old), (~op.isin("u", "d"), INSERT, new)]
    return _images(_parsed(df, column), spec, rows)


def decode_ogg(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """`OP_TYPE` in any case; values by the position of the first name that matches, whatever its case."""
    op = F.coalesce(F.upper(_text("$.OP_TYPE")), F.lit(""))
    names = F.transform(F.try_variant_get("_v", "$.COLUMN_NAME", "array<variant>"), lambda v: F.lower(F.try_variant_get(v, "$", "string")))

    def image(path: str) -> Column:
        values = F.try_variant_get("_v", path, "array<variant>")
        keys, items = [], []
        for c in spec.columns:
            at = F.array_position(names, c.name.lower())
            keys.append(F.lit(c.name))
            items.append(F.when(at > 0, F.get(values, (at - 1).cast("int"))))
        return F.map_from_arrays(F.array(*keys), F.array(*items))

    before, after = image("$.BEFORE_VALUE"), image("$.AFTER_VALUE")
    rows = [(op == "UPDATE", BEFORE, before), (op == "UPDATE", AFTER, after), (op == "DELETE", DELETE, before), (~op.isin("UPDATE", "DELETE"), INSERT, after)]
    return _images(_parsed(df, column), spec, rows, nested=False)


def decode_canal_client(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """`eventType` and `data`, with camel or snake keys of the envelope."""
    event = F.lower(F.coalesce(_text("$.eventType"), _text("$.event_type"), F.lit("insert")))
    data = _or_empty(_at("$.data"))
    return _images(_parsed(df, column), spec, [(event == "update", AFTER, data), (event == "delete", DELETE, data), (~event.isin("update", "delete"), INSERT, data)])


def _values(df: DataFrame, spec: TableSpec, others: str) -> dict[str, Column]:
    """JSON texts of the data columns by the table's names; positions decide."""
    own = data_columns(df)
    return {c.name: json_value(F.col(f"`{own[i]}`"), df.schema[own[i]].dataType, "hex", others) for i, c in enumerate(spec.columns) if i < len(own)}


def _message(df: DataFrame, message: Column) -> DataFrame:
    return df.select(*[c for c in META if c in df.columns], message.alias("message"))


def _str(x: str) -> Column:
    import json

    return F.lit(json.dumps(x, ensure_ascii=False))


def encode_json(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _message(df, json_object(_values(df, spec, "typed")))


def encode_compatible(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _message(df, json_object(_values(df, spec, "text")))


def encode_native(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _message(df, json_object(_values(df, spec, "text")))


def _by_kind(cases: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for kind, value in cases.items():
        out = F.when(F.col("_kind") == kind, value).otherwise(out)
    return out


def _now(ts: Column | None) -> Column:
    return (ts if ts is not None else F.unix_millis(F.current_timestamp())).cast("string")


def encode_canal(df: DataFrame, spec: TableSpec, ts: Column | None = None) -> DataFrame:
    """Without `old`: a before image is written as an update of its own."""
    kind = _by_kind({DELETE: '"DELETE"', BEFORE: '"UPDATE"', AFTER: '"UPDATE"'}, '"INSERT"')
    return _message(df, json_object({"_type": kind, "_ts": _now(ts), "data": json_array([json_object(_values(df, spec, "text"))])}))


def encode_debezium(df: DataFrame, spec: TableSpec, ts: Column | None = None) -> DataFrame:
    """An after image is written under both `before` and `after`, a before image under `before`."""
    image, now = json_object(_values(df, spec, "text")), _now(ts)
    op = _by_kind({BEFORE: '"u"', AFTER: '"u"', DELETE: '"d"'}, '"c"')
    tail = {"op": op, "source": json_object({"ts_ms": now}), "ts_ms": now}
    both, before, after = json_object(tail | {"after": image, "before": image}), json_object(tail | {"before": image}), json_object(tail | {"after": image})
    return _message(df, F.when(F.col("_kind") == AFTER, both).when(F.col("_kind").isin(BEFORE, DELETE), before).otherwise(after))


def encode_maxwell(df: DataFrame, spec: TableSpec) -> DataFrame:
    image = json_object(_values(df, spec, "text"))
    kind = _by_kind({DELETE: '"delete"', BEFORE: '"update"', AFTER: '"update"'}, '"insert"')
    parts = {"database": _str("default"), "table": _str(spec.identifier), "type": kind, "xoffset": F.lit("0"), "commit": F.lit("true"), "data": image}
    return _message(df, F.when(F.col("_kind") == BEFORE, json_object(parts | {"old": image})).otherwise(json_object(parts)))


def encode_ogg(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Updates are written as MODIFY and deletes without an image before, so reading them back gives inserts and nulls."""
    values = _values(df, spec, "text")
    kind = _by_kind({DELETE: '"DELETE"', BEFORE: '"MODIFY"', AFTER: '"MODIFY"'}, '"INSERT"')
    names = json_array([_str(c.name) for c in spec.columns])
    return _message(df, json_object({"OP_TYPE": kind, "COLUMN_NAME": names, "AFTER_VALUE": json_array([values.get(c.name, F.lit("null")) for c in spec.columns])}))


#: Types of the connect envelope.
CONNECT_TYPES = {"boolean": "boolean", "int": "int32", "bigint": "int64", "double": "double", "bytes": "bytes"}


def encode_connect(df: DataFrame, spec: TableSpec) -> DataFrame:
    fields = json_array([json_object({"type": _str(CONNECT_TYPES.get(c.type, "string")), "field": _str(c.name)}) for c in spec.columns])
    return _message(df, json_object({"schema": json_object({"type": _str("struct"), "fields": fields}), "payload": json_object(_values(df, spec, "text"))}))
