"""The registered queries of the engine's own operators, each with its SQL.

Change data is derived from `events` by fixed rules: the kind from the event type, the origin `shop.<event type>`, the order
from the event's id, the key from the user; nulls are made where the id is a multiple of 7 and for errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow import codecs
from changeflow.functions import scalars
from changeflow.functions.display import display
from changeflow.model import TableSpec, align, kind_code, kind_from_code
from changeflow.operators import canal_client, changelog, filters, metrics, routing, splits, transactions
from changeflow.operators import transforms as T
from changeflow.schema import evolution as ev
from changeflow.sinks import external
from changeflow.sources import cdc, fake

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

KIND_OF = {"signup": "INSERT", "purchase": "INSERT", "view": "UPDATE_BEFORE", "click": "UPDATE_AFTER", "error": "DELETE"}
#: The same derivation in SQL.
CHANGES = """c AS (SELECT user_id, nullif(event_type, 'error') AS name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  event_id % 2 = 0 AS flag, CASE event_type WHEN 'view' THEN 'UPDATE_BEFORE' WHEN 'click' THEN 'UPDATE_AFTER' WHEN 'error' THEN 'DELETE' ELSE 'INSERT' END AS _kind,
  'shop.' || event_type AS _origin, event_id AS _seq FROM events)"""
SPEC = TableSpec.of("shop.users", "user_id", user_id="bigint", name="string", value="double", flag="boolean")


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("name"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        (F.col("event_id") % 2 == 0).alias("flag"),
        F.coalesce(kinds[F.col("event_type")], F.lit("INSERT")).alias("_kind"),
        F.concat(F.lit("shop."), "event_type").alias("_origin"),
        F.col("event_id").alias("_seq"),
    )


ALL = "user_id, name, value, flag, _kind, _origin, _seq"


def _filter(name: str, index: int, op: str, value, where: str) -> None:
    query(name, f"WITH {CHANGES} SELECT {ALL} FROM c WHERE {where}")(lambda s, d: filters.filter_by_index(changes(s, d), index, op, value))


_filter("filter_gt", 2, ">", 100, "coalesce(value > 100, false)")
_filter("filter_ge_text_value", 2, ">=", "50.5", "coalesce(value >= 50.5, false)")
_filter("filter_lt", 0, "<", 10, "user_id < 10")
_filter("filter_le", 2, "le", 20, "coalesce(value <= 20, false)")
_filter("filter_eq_text", 1, "=", "click", "coalesce(name = 'click', false)")
_filter("filter_eq_number", 0, "==", 7, "user_id = 7")
_filter("filter_ne_keeps_null", 1, "!=", "click", "NOT coalesce(name = 'click', false)")
_filter("filter_eq_boolean_is_false", 3, "=", "true", "false")
_filter("filter_ne_boolean_passes", 3, "!=", "true", "true")
_filter("filter_gt_on_text_drops", 1, ">", 1, "false")
_filter("filter_not_null", 1, "not_null", None, "name IS NOT NULL")
_filter("filter_is_null", 2, "is_null", None, "value IS NULL")
_filter("filter_missing_index", 9, "is_null", None, "false")
_filter("filter_ne_without_value", 0, "!=", None, "true")


@query("map_columns", f"WITH {CHANGES} SELECT user_id * 2 AS user_id, upper(name) AS name, value, flag, _kind, _origin, _seq FROM c")
def _(s, d):
    return T.map_columns(user_id=F.col("user_id") * 2, name=F.upper("name"))(changes(s, d))


for _mode, _n, _copies in (("all", 0, 3), ("first", 1, 1), ("first", 5, 0), ("n", 2, 2), ("n", 9, 3)):
    query(f"fanout_{_mode}_{_n}", f"WITH {CHANGES} SELECT {ALL} FROM c, range({_copies})")(lambda s, d, m=_mode, n=_n: T.fanout(m, n)(changes(s, d)))


@query("rename", f"WITH {CHANGES} SELECT user_id AS id, name, value AS amount, flag, _kind, _origin, _seq FROM c")
def _(s, d):
    return T.rename([("user_id", "id"), ("user_id", "other"), ("value", "amount")])(changes(s, d))


@query("select_by_index", f"WITH {CHANGES} SELECT value, user_id, CAST(NULL AS VARCHAR) AS _missing2, _kind, CAST(NULL AS VARCHAR) AS _origin, _seq FROM c")
def _(s, d):
    return T.select([2, 0, 11])(changes(s, d))


@query("transform_pipeline", f"WITH {CHANGES} SELECT user_id * 2 AS user_id, name, value, flag, _kind, _origin, _seq FROM c, range(2) WHERE coalesce(value > 50, false)")
def _(s, d):
    steps = [lambda df: filters.filter_by_index(df, 2, ">", 50), T.map_columns(user_id=F.col("user_id") * 2), T.fanout("n", 2)]
    return T.compose(steps)(changes(s, d))


@query("sql_transform", f"WITH {CHANGES} SELECT name, count(*) AS n, sum(user_id)::BIGINT AS users, max(value) AS top FROM c WHERE _kind <> 'DELETE' GROUP BY name")
def _(s, d):
    return T.sql("SELECT name, count(*) AS n, sum(user_id) AS users, max(value) AS top FROM source WHERE _kind <> 'DELETE' GROUP BY name")(changes(s, d))


@query("row_kind_codes", f"""WITH {CHANGES}, k AS (SELECT _seq, CASE _kind WHEN 'INSERT' THEN 'c' WHEN 'UPDATE_AFTER' THEN 'u' WHEN 'UPDATE_BEFORE' THEN 'b' ELSE 'd' END AS code, _kind AS back FROM c)
  SELECT * FROM k""")
def _(s, d):
    return changes(s, d).withColumn("code", kind_code(F.col("_kind"))).select("_seq", "code", kind_from_code(F.col("code")).alias("back"))


@query("align_row", f"WITH {CHANGES} SELECT CAST(user_id AS VARCHAR) AS a, name AS b, value AS c, flag AS d, CAST(NULL AS BIGINT) AS e, _kind, _origin, _seq FROM c")
def _(s, d):
    return align(changes(s, d), TableSpec.of("t", a="string", b="string", c="double", d="boolean", e="bigint"))


# Codecs: messages are built from plain columns, decoded, and compared with those columns.

def _message(s, d, build) -> DataFrame:
    return changes(s, d).select(build.alias("m"), "_origin", "_seq")


def _json(**columns) -> F.Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


_ROW = lambda: F.struct("user_id", "name", "value", "flag")


@query("decode_json", f"WITH {CHANGES} SELECT user_id, name, value, flag, 'INSERT' AS _kind, _origin, _seq FROM c")
def _(s, d):
    return codecs.decode(_message(s, d, F.to_json(_ROW(), {"ignoreNullFields": "false"})), "m", SPEC, "json")


@query("decode_native_floats_as_text", f"WITH {CHANGES} SELECT user_id, name, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS value, flag, 'INSERT' AS _kind, _origin, _seq FROM c")
def _(s, d):
    return codecs.decode(_message(s, d, F.to_json(_ROW(), {"ignoreNullFields": "false"})), "m", SPEC, "native")


@query("decode_connect", f"WITH {CHANGES} SELECT CASE WHEN _seq % 3 > 0 THEN user_id END AS user_id, CASE WHEN _seq % 3 > 0 THEN name END AS name, CASE WHEN _seq % 3 > 0 THEN value END AS value, CASE WHEN _seq % 3 > 0 THEN flag END AS flag, 'INSERT' AS _kind, _origin, _seq FROM c")
def _(s, d):
    return codecs.decode(_message(s, d, _json(payload=F.when(F.col("_seq") % 3 > 0, _ROW()))), "m", SPEC, "compatible-kafka-connect-json")


_SPLIT = """SELECT {old}, 'UPDATE_BEFORE' AS _kind, _origin, _seq FROM c WHERE _kind LIKE 'UPDATE%' UNION ALL
  SELECT user_id, name, value, flag, CASE WHEN _kind LIKE 'UPDATE%' THEN 'UPDATE_AFTER' ELSE _kind END, _origin, _seq FROM c"""
_OLD = "NULL::BIGINT AS user_id, 'was ' || user_id AS name, NULL::DOUBLE AS value, NULL::BOOLEAN AS flag"


def _op(insert: str, update: str, delete: str) -> F.Column:
    return F.when(F.col("_kind").startswith("UPDATE"), update).when(F.col("_kind") == "DELETE", delete).otherwise(insert)


_WAS = lambda: F.concat(F.lit("was "), "user_id")


@query("decode_canal", f"WITH {CHANGES} " + _SPLIT.format(old=_OLD))
def _(s, d):
    return codecs.decode(_message(s, d, _json(_type=_op("INSERT", "UPDATE", "DELETE"), data=F.array(_ROW()), old=F.array(F.struct(_WAS().alias("name"))))), "m", SPEC, "canal-json")


@query("decode_maxwell", f"WITH {CHANGES} " + _SPLIT.format(old=_OLD))
def _(s, d):
    return codecs.decode(_message(s, d, _json(type=_op("bootstrap-insert", "update", "delete"), data=_ROW(), old=F.struct(_WAS().alias("name")))), "m", SPEC, "maxwell-json")


@query("decode_canal_client", f"WITH {CHANGES} SELECT user_id, name, value, flag, CASE WHEN _kind LIKE 'UPDATE%' THEN 'UPDATE_AFTER' ELSE _kind END AS _kind, _origin, _seq FROM c")
def _(s, d):
    return codecs.decode(_message(s, d, _json(eventType=_op("insert", "Update", "delete"), data=_ROW())), "m", SPEC, "canal-client-json")


@query("canal_client_tables", f"""WITH {CHANGES}, x AS (SELECT * FROM c WHERE _kind IN ('INSERT', 'DELETE') AND _origin IN ('shop.signup', 'shop.error'))
  SELECT _origin, _seq, CAST(user_id AS VARCHAR) AS key, '{{"data":{{"' || CASE WHEN _origin = 'shop.signup' THEN 'id' ELSE 'who' END || '":' || user_id || '}},"db_name":"shop","event_type":"' || lower(_kind) || '","request_id":"r' || _seq || '","table_name":"' || split_part(_origin, '.', 2) || '"}}' AS payload
  FROM x""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    rows = changes(s, d).filter("_kind IN ('INSERT', 'DELETE') AND _origin IN ('shop.signup', 'shop.error')")
    registry = {"shop.signup": canal_client.Fields("user_id", {"user_id": "id"}), "shop.error": canal_client.Fields("user_id", {"user_id": "who"})}
    return canal_client.encode_tables(rows, registry, naming="snake", width=100, request_id=F.concat(F.lit("r"), "_seq"))


@query("decode_debezium", f"""WITH {CHANGES} SELECT user_id, 'was ' || user_id AS name, value, flag, 'UPDATE_BEFORE' AS _kind, _origin, _seq FROM c WHERE _kind LIKE 'UPDATE%' UNION ALL
  SELECT user_id, CASE WHEN _kind = 'DELETE' THEN 'was ' || user_id ELSE name END, value, flag, CASE WHEN _kind LIKE 'UPDATE%' THEN 'UPDATE_AFTER' ELSE _kind END, _origin, _seq FROM c""")
def _(s, d):
    return codecs.decode(_message(s, d, _json(op=_op("r", "u", "d"), before=F.struct(_WAS().alias("name")), after=_ROW())), "m", SPEC, "debezium-json")


@query("decode_ogg", f"WITH {CHANGES}, x AS (" + _SPLIT.format(old="user_id, 'was ' || user_id AS name, NULL::DOUBLE AS value, NULL::BOOLEAN AS flag") + ") SELECT user_id, CASE WHEN _kind = 'DELETE' THEN 'was ' || user_id ELSE name END AS name, NULL::DOUBLE AS value, NULL::BOOLEAN AS flag, _kind, _origin, _seq FROM x")
def _(s, d):
    names = F.array(F.lit("USER_ID"), F.lit("Name"))
    ids = F.col("user_id").cast("string")
    build = _json(OP_TYPE=_op("insert", "Update", "DELETE"), COLUMN_NAME=names, AFTER_VALUE=F.array(ids, "name"), BEFORE_VALUE=F.array(ids, _WAS()))
    return codecs.decode(_message(s, d, build), "m", SPEC, "ogg-json")


@query("decode_text", f"WITH {CHANGES} SELECT user_id, name, value, flag, 'INSERT' AS _kind, _origin, _seq FROM c")
def _(s, d):
    line = F.concat_ws("|", F.col("user_id").cast("string"), F.coalesce("name", F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit("")), F.when(F.col("flag"), "yes").otherwise("0"))
    return codecs.decode(_message(s, d, F.concat(line, F.lit("\r\n"))), "m", SPEC, "text")


_WIRE = TableSpec.of("shop.users", user_id="bigint", name="string", value="string", flag="boolean")
for _fmt, _flag in (("avro", "flag"), ("protobuf", "flag")):
    query(f"{_fmt}_round_trip", f"WITH {CHANGES} SELECT user_id, coalesce(name, '') AS name, coalesce(regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), '') AS value, {'CAST(flag AS VARCHAR)' if _fmt == 'avro' else 'flag'} AS flag, 'INSERT' AS _kind, _origin, _seq FROM c")(
        lambda s, d, f=_fmt: codecs.decode(codecs.encode(changes(s, d), _WIRE, f), "message", TableSpec.of("t", user_id="bigint", name="string", value="string", flag="string") if f == "avro" else _WIRE, f)
    )

# Encoders: SQL writes the same JSON by hand, keys in alphabetical order.
_QUOTE = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
_NUM = "regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')"
_TEXT_ROW = f"""'{{"flag":' || CAST(flag AS VARCHAR) || ',"name":' || {_QUOTE('name')} || ',"user_id":' || user_id || ',"value":' || {_QUOTE(_NUM)} || '}}'"""
_TYPED_ROW = f"""'{{"flag":' || CAST(flag AS VARCHAR) || ',"name":' || {_QUOTE('name')} || ',"user_id":' || user_id || ',"value":' || coalesce(CAST(value AS VARCHAR), 'null') || '}}'"""


def _encoder(name: str, fmt: str, message: str, **options) -> None:
    query(name, f"WITH {CHANGES} SELECT _kind, _origin, _seq, {message} AS message FROM c")(lambda s, d: codecs.encode(changes(s, d), SPEC, fmt, **{k: v() for k, v in options.items()}))


_encoder("encode_json", "json", _TYPED_ROW)
_encoder("encode_native", "native", _TEXT_ROW)
_encoder("encode_compatible_debezium", "compatible-debezium-json", _TEXT_ROW)
_encoder("encode_canal", "canal-json", f"""'{{"_ts":' || _seq || ',"_type":"' || CASE WHEN _kind LIKE 'UPDATE%' THEN 'UPDATE' ELSE _kind END || '","data":[' || {_TEXT_ROW} || ']}}'""", ts=lambda: F.col("_seq"))
_encoder("encode_maxwell", "maxwell-json", f"""'{{"commit":true,"data":' || {_TEXT_ROW} || ',"database":"default",' || CASE WHEN _kind = 'UPDATE_BEFORE' THEN '"old":' || {_TEXT_ROW} || ',' ELSE '' END || '"table":"shop.users","type":"' || CASE WHEN _kind LIKE 'UPDATE%' THEN 'update' ELSE lower(_kind) END || '","xoffset":0}}'""")
_encoder("encode_debezium", "debezium-json", f"""'{{' || CASE WHEN _kind IN ('INSERT', 'UPDATE_AFTER') THEN '"after":' || {_TEXT_ROW} || ',' ELSE '' END || CASE WHEN _kind <> 'INSERT' THEN '"before":' || {_TEXT_ROW} || ',' ELSE '' END || '"op":"' || CASE WHEN _kind LIKE 'UPDATE%' THEN 'u' WHEN _kind = 'DELETE' THEN 'd' ELSE 'c' END || '","source":{{"ts_ms":' || _seq || '}},"ts_ms":' || _seq || '}}'""", ts=lambda: F.col("_seq"))
_encoder("encode_ogg", "ogg-json", f"""'{{"AFTER_VALUE":[' || user_id || ',' || {_QUOTE('name')} || ',' || {_QUOTE(_NUM)} || ',' || CAST(flag AS VARCHAR) || '],"COLUMN_NAME":["user_id","name","value","flag"],"OP_TYPE":"' || CASE WHEN _kind LIKE 'UPDATE%' THEN 'MODIFY' ELSE _kind END || '"}}'""")
_encoder("encode_connect", "compatible-kafka-connect-json", f"""'{{"payload":' || {_TEXT_ROW} || ',"schema":{{"fields":[{{"field":"user_id","type":"int64"}},{{"field":"name","type":"string"}},{{"field":"value","type":"double"}},{{"field":"flag","type":"boolean"}}],"type":"struct"}}}}'""")
_encoder("encode_text", "text", f"user_id || '|' || coalesce(name, '') || '|' || coalesce({_NUM}, '') || '|' || CAST(flag AS VARCHAR)")

# Changelogs. The base table is every user's first event.
_BASE = "b AS (SELECT user_id, 'base' AS name, -1.0::DOUBLE AS value, false AS flag FROM (SELECT DISTINCT user_id FROM events))"


def _base(s, d) -> DataFrame:
    return table(s, d, "events").select("user_id").distinct().select("user_id", F.lit("base").alias("name"), F.lit(-1.0).alias("value"), F.lit(False).alias("flag"))


def _applied(policy: changelog.Policy) -> str:
    kinds = ", ".join(f"'{k}'" for k in (*policy.upsert, *policy.delete))
    puts = ", ".join(f"'{k}'" for k in policy.upsert)
    return f"""WITH {CHANGES}, {_BASE}, l AS (SELECT * FROM c WHERE _kind IN ({kinds}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1)
      SELECT user_id, name, value, flag FROM b WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, name, value, flag FROM l WHERE _kind IN ({puts})"""


for _p in changelog.POLICIES.values():
    query(f"apply_{_p.name.replace('-', '_')}", _applied(_p))(lambda s, d, p=_p: changelog.apply_changelog(_base(s, d), changes(s, d), ["user_id"], p))


@query("apply_without_key", f"WITH {CHANGES}, {_BASE} SELECT user_id, name, value, flag FROM b UNION ALL SELECT user_id, name, value, flag FROM c WHERE _kind IN ('INSERT', 'UPDATE_AFTER')")
def _(s, d):
    return changelog.apply_changelog(_base(s, d), changes(s, d), [], changelog.JDBC)


@query("latest_by_key", f"WITH {CHANGES} SELECT {ALL} FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1")
def _(s, d):
    return changelog.latest_by_key(changes(s, d), ["user_id"])


@query("delete_runs", f"""WITH {CHANGES}, a AS (SELECT _origin, _seq, CASE WHEN _kind = 'DELETE' THEN 'delete' ELSE 'upsert' END AS _op FROM (SELECT * REPLACE ('shop.all' AS _origin) FROM c) WHERE _kind <> 'UPDATE_BEFORE'),
  t AS (SELECT *, CASE WHEN _op <> lag(_op) OVER w THEN 1 ELSE 0 END AS t FROM a WINDOW w AS (PARTITION BY _origin ORDER BY _seq))
  SELECT _origin, _seq, _op, (sum(t) OVER (PARTITION BY _origin ORDER BY _seq))::BIGINT AS _run FROM t""")
def _(s, d):
    return changelog.runs(changes(s, d).withColumn("_origin", F.lit("shop.all"))).select("_origin", "_seq", "_op", "_run")


@query("jdbc_statements", f"""WITH {CHANGES}, l AS (SELECT * FROM c WHERE true QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1),
  q AS (SELECT CASE WHEN _kind = 'DELETE' THEN 'DELETE FROM `shop`.`users` WHERE `user_id` = ?' WHEN _kind <> 'UPDATE_BEFORE' THEN
    'INSERT INTO `shop`.`users` (`user_id`, `name`, `value`, `flag`) VALUES (?, ?, ?, ?) ON DUPLICATE KEY UPDATE `name` = VALUES(`name`), `value` = VALUES(`value`), `flag` = VALUES(`flag`)' END AS sql FROM l)
  SELECT sql, count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches FROM q WHERE sql IS NOT NULL GROUP BY sql""")
def _(s, d):
    from changeflow.schema.dialects import MYSQL

    return external.statements(changes(s, d), SPEC, MYSQL)


@query("bulk_actions", f"""WITH {CHANGES} SELECT _seq, CASE WHEN _kind IN ('INSERT', 'UPDATE_AFTER') THEN '{{"update":{{"_id":"' || user_id || '","_index":"i-' || split_part(_origin, '.', 2) || '"}}}}' || chr(10) || '{{"doc":' || {_TYPED_ROW} || ',"doc_as_upsert":true}}' || chr(10)
  ELSE '{{"delete":{{"_id":"' || user_id || '","_index":"i-' || split_part(_origin, '.', 2) || '"}}}}' || chr(10) END AS lines FROM c""")
def _(s, d):
    return changelog.bulk_lines(changes(s, d), ["user_id"], "i-${table_name}")


@query("bulk_without_id", f"""WITH {CHANGES} SELECT _seq, CASE WHEN name IS NULL THEN '{{"index":{{"_index":"i"}}}}' || chr(10) || {_TYPED_ROW} || chr(10) ELSE '{{"update":{{"_id":"' || name || '-' || user_id || '","_index":"i"}}}}' || chr(10) || '{{"doc":' || {_TYPED_ROW} || ',"doc_as_upsert":true}}' || chr(10) END AS lines
  FROM c WHERE _kind IN ('INSERT', 'UPDATE_AFTER')""")
def _(s, d):
    return changelog.bulk_lines(changes(s, d), ["name", "user_id"], "i", enable_delete=False, delimiter="-")


@query("redis_hash", f"""WITH {CHANGES} SELECT _seq, CASE WHEN _kind IN ('INSERT', 'UPDATE_AFTER') THEN 'HSET' ELSE 'HDEL' END AS command, 'u:' || user_id AS key, coalesce(name, '') AS field,
  coalesce(CAST(flag AS VARCHAR), '') AS value FROM c""")
def _(s, d):
    return changelog.redis_commands(changes(s, d), "hash", "u:${f0}", "${f1}", "${f3}")


@query("select_tables", f"WITH {CHANGES} SELECT {ALL} FROM c WHERE _origin = 'shop.click' OR regexp_matches(_origin, 'p\\.s')")
def _(s, d):
    return routing.select_tables(changes(s, d), routing.TableSelector(tables=("shop.click",), table_patterns=(r"p\.s",)))


@query("select_tables_narrowed", f"WITH {CHANGES} SELECT {ALL} FROM c WHERE false")
def _(s, d):
    return routing.select_tables(changes(s, d), routing.TableSelector(databases=("other",), tables=("shop.click",)))


@query("select_tables_legacy", f"WITH {CHANGES} SELECT {ALL} FROM c WHERE _origin LIKE 'shop.p%'")
def _(s, d):
    return routing.select_tables(changes(s, d), routing.TableSelector.legacy("sh%", "p%"))


@query("route_topics", f"""WITH {CHANGES}, r AS (SELECT _seq, unnest(CASE WHEN _origin IN ('shop.click', 'shop.view') THEN ['seen-' || split_part(_origin, '.', 2), 'all-seen'] WHEN _origin = 'shop.purchase' THEN ['all-seen'] ELSE ['shop.rest'] END) AS topic FROM c)
  SELECT * FROM r""")
def _(s, d):
    routes = [(r"shop\.(click|view)", "seen-${table}"), (r"shop\.(click|view|purchase)", "all-seen"), (r"shop\.purchase", "all-seen"), ("hop.click", "never")]
    return routing.fan_out_topics(changes(s, d), "${database}.rest", routes).select("_seq", "topic")


@query("queue_messages_json", f"""WITH {CHANGES} SELECT user_id || '_' || coalesce(name, '') AS key, '[' || user_id || ',' || {_QUOTE('name')} || ',' || coalesce(CAST(value AS VARCHAR), 'null') || ',' || CAST(flag AS VARCHAR) || ']' AS value, 't' AS topic FROM c""")
def _(s, d):
    return routing.messages(changes(s, d), "t", keys=["#0", "f1"])


@query("queue_messages_text", f"""WITH {CHANGES} SELECT '' AS key, user_id || ';' || coalesce(name, '') || ';' || coalesce({_NUM}, '') || ';' || CAST(flag AS VARCHAR) AS value, 't' AS topic FROM c""")
def _(s, d):
    return routing.messages(changes(s, d), "t", fmt="text", delimiter=";")


@query("console_lines", f"""WITH {CHANGES} SELECT '[console] {{"f0":' || user_id || ',"f1":' || {_QUOTE('name')} || ',"f2":' || coalesce(CAST(value AS VARCHAR), 'null') || ',"f3":' || CAST(flag AS VARCHAR) || '}}' AS line FROM c""")
def _(s, d):
    return routing.console_lines(changes(s, d))


@query("canal_client_messages", f"""WITH {CHANGES}, x AS (SELECT * REPLACE ('shop.users' AS _origin) FROM c),
  u AS (SELECT *, lag(_kind) OVER w AS pk, lag(value) OVER w AS pv, lag(name) OVER w AS pn, lag(user_id) OVER w AS pu, lead(_kind) OVER w AS nk FROM x WHERE _kind LIKE 'UPDATE%' WINDOW w AS (ORDER BY _seq)),
  m AS (SELECT _seq, user_id, name, value, pu, pn, pv, CASE WHEN _kind = 'UPDATE_BEFORE' THEN 'delete' ELSE 'update' END AS e, coalesce(_kind = 'UPDATE_AFTER' AND pk = 'UPDATE_BEFORE', false) AS paired FROM u WHERE NOT coalesce(_kind = 'UPDATE_BEFORE' AND nk = 'UPDATE_AFTER', false)
    UNION ALL SELECT _seq, user_id, name, value, NULL, NULL, NULL, lower(_kind), false FROM x WHERE _kind IN ('INSERT', 'DELETE'))
  SELECT 'shop.users' AS _origin, _seq, CAST(user_id AS VARCHAR) AS key, '{{"data":{{' || CASE WHEN e <> 'delete' AND (NOT paired OR coalesce(CAST(value AS VARCHAR), 'null') <> coalesce(CAST(pv AS VARCHAR), 'null')) THEN '"amount":' || coalesce(CAST(value AS VARCHAR), 'null') || ',' ELSE '' END ||
    '"id":' || user_id || '}},"dbName":"shop","eventType":"' || e || '",' || CASE WHEN paired THEN '"oldData":{{"amount":' || coalesce(CAST(pv AS VARCHAR), 'null') || ',"id":' || pu || '}},' ELSE '' END || '"requestId":"r' || _seq || '","tableName":"users"}}' AS payload
  FROM m WHERE NOT paired OR user_id <> pu OR coalesce(CAST(value AS VARCHAR), 'null') <> coalesce(CAST(pv AS VARCHAR), 'null')""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    rows = changes(s, d).withColumn("_origin", F.lit("shop.users"))
    return canal_client.encode(rows, canal_client.Fields("user_id", {"user_id": "id"}, {"value": "amount"}), width=100, request_id=F.concat(F.lit("r"), "_seq"))


@query("match_transactions", """WITH p AS (SELECT o_orderkey AS handle, o_orderkey * 10 AS start_ts, o_orderkey * 10 + 5 AS commit_ts, o_orderstatus AS st, o_orderpriority AS v FROM orders)
  SELECT handle, CASE WHEN st = 'F' THEN NULL ELSE v END AS value, CASE WHEN st = 'F' THEN 'DELETE' WHEN handle % 2 = 0 THEN 'UPDATE_AFTER' ELSE 'INSERT' END AS _kind, CAST(NULL AS VARCHAR) AS _origin, commit_ts AS _seq
  FROM p WHERE handle % 5 <> 0 AND handle % 7 <> 0 AND commit_ts <= (SELECT max(commit_ts) * 9 // 10 FROM p)""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("handle"), (F.col("o_orderkey") * 10).alias("start_ts"), "o_orderstatus", "o_orderpriority")
    none = F.lit(None).cast("string")
    pre = o.select(F.lit("prewrite").alias("type"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"), "handle", "start_ts", F.lit(None).cast("bigint").alias("commit_ts"), F.col("o_orderpriority").alias("value"), F.when((F.col("handle") % 2 == 0) & (F.col("o_orderstatus") != "F"), "was").alias("old_value"))
    com = o.filter("handle % 7 <> 0").select(F.lit("commit").alias("type"), none.alias("op"), "handle", "start_ts", (F.col("start_ts") + 5).alias("commit_ts"), none.alias("value"), none.alias("old_value"))
    back = o.filter("handle % 5 = 0").select(F.lit("rollback").alias("type"), none.alias("op"), "handle", "start_ts", F.lit(None).cast("bigint").alias("commit_ts"), none.alias("value"), none.alias("old_value"))
    reached = o.agg(F.expr("(max(start_ts) + 5) * 9 div 10").alias("resolved_ts"))
    return transactions.match(pre.unionByName(com).unionByName(back), reached)


@query("resolved_ts", "SELECT min(t) AS resolved_ts FROM (SELECT event_type, min(event_id) AS t FROM events GROUP BY event_type)")
def _(s, d):
    return transactions.resolved_ts(table(s, d, "events").select(F.col("event_type").alias("table"), F.col("event_id").alias("ts")))


@query("split_ranges", "SELECT o_orderkey, o_orderkey // 100 AS _range, (o_orderkey // 100) % 4 AS _subtask FROM orders")
def _(s, d):
    return splits.with_range(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0, 100_000, 4, 100)


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 50 AND o_orderkey < 900 ORDER BY o_orderkey LIMIT 100")
def _(s, d):
    return splits.keyset_page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, 900, 100)


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def _(s, d):
    return splits.offset_page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200, 100)


@query("sliding_metrics", """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS sent, max(value) OVER w AS max_latency FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW)""")
def _(s, d):
    e = table(s, d, "events").withColumn("one", F.lit(1).cast("bigint"))
    return metrics.sliding(e, "ts", ["event_type"], 3600, sent="one", max_latency="value").select("event_id", "sent", "max_latency")


@query("ema", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(sum(value * CASE WHEN k = n - 1 THEN 1 ELSE 0.2 END * pow(0.8, k)), 6) AS ema FROM o GROUP BY event_type""")
def _(s, d):
    return metrics.ema_by(table(s, d, "events"), ["event_type"], "event_id", "value").select("event_type", F.round("ema", 6).alias("ema"))


@query("nearest_rank", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, max(n) AS n, max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.99 + 0.5) THEN value END) AS p99, round(avg(value), 6) AS avg, max(value) AS max FROM o GROUP BY event_type""")
def _(s, d):
    got = metrics.nearest_rank(table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})
    return got.withColumn("avg", F.round("avg", 6))


@query("tumbling_p99", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY hour, event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY hour, event_type) AS n
    FROM (SELECT event_type, date_trunc('hour', ts) AS hour, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL))
  SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS at, max(n) AS n, max(CASE WHEN i = floor((n - 1) * 0.99 + 0.5) THEN value END) AS p99, max(value) AS max FROM o GROUP BY event_type, hour""")
def _(s, d):
    got = metrics.tumbling(table(s, d, "events"), "ts", "value", {"p99": 0.99}, ["event_type"], "1 hour")
    return got.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("at"), "n", "p99", "max")


@query("in_flight", f"WITH {CHANGES} SELECT _seq, greatest(user_id - 20 - _seq % 3, 0) AS gauge FROM c")
def _(s, d):
    return changes(s, d).select("_seq", metrics.in_flight(F.col("user_id"), F.lit(20), F.col("_seq") % 3).alias("gauge"))


@query("start_at_timestamp", f"SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def _(s, d):
    return cdc.start_at(table(s, d, "events"), "timestamp", "ts", F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "value")


@query("stop_at_timestamp", "SELECT event_id, value FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE ts > TIMESTAMP '2024-01-20'), 9223372036854775807)")
def _(s, d):
    e = table(s, d, "events").withColumn("_seq", F.col("event_id"))
    return cdc.stop_at(e, "timestamp", "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "value")


@query("hand_over", f"""WITH {CHANGES}, s AS (SELECT user_id, name, value, flag, 'INSERT' AS _kind, 'shop.users' AS _origin, _seq FROM c WHERE _seq <= 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1)
  SELECT * FROM s UNION ALL SELECT {ALL} FROM c WHERE _seq > 100""")
def _(s, d):
    c = changes(s, d)
    snapshot = changelog.latest_by_key(c.filter("_seq <= 100"), ["user_id"]).withColumn("_kind", F.lit("INSERT")).withColumn("_origin", F.lit("shop.users"))
    return cdc.hand_over(snapshot, c, ["user_id"], 100)


@query("positional_decode", "SELECT list_value(event_type, CAST(event_id AS VARCHAR)) AS fields, 'INSERT' AS _kind FROM events")
def _(s, d):
    return cdc.positional(table(s, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("z"), F.col("event_type").alias("a"))).alias("m")), "m")


@query("drill_array", "SELECT list_value(CAST(event_id AS VARCHAR), event_type) AS fields, 'INSERT' AS _kind FROM events, range(2)")
def _(s, d):
    one = F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"))
    return cdc.drill(table(s, d, "events").select(F.to_json(F.struct(F.struct(F.array(one, one).alias("rows")).alias("data"))).alias("m")), "m", "data.rows")


@query("fake_source", "SELECT i AS f0, 'fake-row-' || i AS f1, i % 2 = 0 AS f2, 'INSERT' AS _kind, CAST(NULL AS VARCHAR) AS _origin, i AS _seq FROM range(100) t(i)")
def _(s, d):
    return fake.rows(s, 100)


@query("fake_engine_source", "SELECT i AS f0, 'row_' || i AS f1, i % 2 = 0 AS f2, CAST(NULL AS VARCHAR) AS f3, CAST(NULL AS VARCHAR) AS f4, 'INSERT' AS _kind, CAST(NULL AS VARCHAR) AS _origin, i AS _seq FROM range(100) t(i)")
def _(s, d):
    return fake.rows(s, 100, "row_", 5)


@query("row_from_map", f"WITH {CHANGES} SELECT user_id, name, CAST(NULL AS DOUBLE) AS value, CASE WHEN _seq % 3 = 0 THEN flag END AS flag, _kind, _origin, _seq FROM c")
def _(s, d):
    c = changes(s, d)
    flag = F.when(F.col("_seq") % 3 == 0, F.col("flag").cast("string")).otherwise("neither")
    values = F.create_map(F.lit("flag"), flag, F.lit("user_id"), F.col("user_id").cast("string"), F.lit("name"), F.col("name"), F.lit("other"), F.lit("x"))
    return T.from_map(c, values, SPEC)


@query("evolve_rows", f"WITH {CHANGES} SELECT user_id, name AS full_name, CAST(value AS BIGINT) AS value, CAST(NULL AS DOUBLE) AS score, _kind, _origin, _seq FROM (SELECT * REPLACE (trunc(value) AS value) FROM c)")
def _(s, d):
    alter = ev.parse_alter("ALTER TABLE shop.users ADD COLUMN score DOUBLE, RENAME COLUMN name TO full_name, MODIFY value BIGINT, DROP COLUMN flag")
    got = ev.evolve(changes(s, d), alter)
    return got.select("user_id", "full_name", "value", "score", "_kind", "_origin", "_seq")


@query("display_text", f"WITH {CHANGES} SELECT _seq, '[' || coalesce('\"' || name || '\"', 'NULL') || ', \"x\"]' AS shown FROM c")
def _(s, d):
    c = changes(s, d).select("_seq", F.array("name", F.lit("x")).alias("a"))
    return c.select("_seq", display(F.col("a"), c.schema["a"].dataType).alias("shown"))


@query("text_scalars", "SELECT event_id, CASE WHEN length(props) > 5 THEN substr(props, 1, 5) || '…' ELSE props END AS cut, trim(regexp_replace('  a ' || event_type || '   b', '\\s+', ' ', 'g')) AS squeezed, 'k-' || event_id || '-' || event_type AS rendered FROM events")
def _(s, d):
    e = table(s, d, "events")
    values = {"f0": F.col("event_id"), "f1": F.col("event_type")}
    return e.select("event_id", scalars.truncate_text(F.col("props"), 5).alias("cut"), scalars.squeeze_space(F.concat(F.lit("  a "), "event_type", F.lit("   b"))).alias("squeezed"), scalars.template("k-${f0}-${f1}", values).alias("rendered"))


@query("number_scalars", "SELECT event_id, event_id * 262144 AS tso, event_id AS back, lpad(upper(to_hex(event_id)), 16, '8000000000000000') AS ordered, event_id AS restored FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id")
    tso, key = scalars.tso_of_millis(F.col("event_id")), scalars.ordered_key(F.col("event_id"))
    return e.select("event_id", tso.alias("tso"), scalars.millis_of_tso(tso).alias("back"), key.alias("ordered"), scalars.from_ordered_key(key).alias("restored"))


@query("byte_keys", """WITH e AS (SELECT event_id, event_id * event_id * 1000003 AS n, event_type || CASE WHEN event_id % 3 = 0 THEN props ELSE '' END AS t FROM events),
  h AS (SELECT *, hex(encode(t)) AS x, strlen(t) AS l FROM e)
  SELECT event_id, array_to_string([lpad(to_hex(((n >> (7 * k)) & 127) + CASE WHEN (n >> (7 * k + 7)) > 0 THEN 128 ELSE 0 END), 2, '0') FOR k IN range(0, 8) IF k = 0 OR (n >> (7 * k)) > 0], '') AS varint,
    n AS restored, array_to_string([rpad(substr(x, 16 * k + 1, 16), 16, '0') || to_hex(247 + least(l - 8 * k, 8)) FOR k IN range(0, l // 8 + 1)], '') AS sortable FROM h""")
def _(s, d):
    k = F.col("event_id")
    e = table(s, d, "events").select("event_id", (k * k * 1000003).alias("n"), F.concat("event_type", F.when(k % 3 == 0, F.col("props")).otherwise("")).alias("t"))
    return e.select("event_id", scalars.varint(F.col("n")).alias("varint"), scalars.from_varint(scalars.varint(F.col("n"))).alias("restored"), scalars.memcomparable(F.col("t")).alias("sortable"))


@query("json_each_row", f"""WITH {CHANGES} SELECT _seq, {_TYPED_ROW} AS line FROM c WHERE _kind IN ('INSERT', 'UPDATE_AFTER')""")
def _(s, d):
    return changelog.json_each_row(changes(s, d))


@query("datetime_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS at, strftime(o_orderdate + INTERVAL 3723 SECOND, '%Y-%m-%d %H:%M:%S') AS later FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    day = F.date_trunc("day", F.col("o_orderdate"))
    return o.select("o_orderkey", scalars.datetime_text(day).alias("at"), scalars.datetime_text(day + F.expr("INTERVAL 3723 SECOND")).alias("later"))


@query("parse_datetime", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch_ms(o_orderdate) END AS ms FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T00:00:00.000"))).when(k == 2, F.concat(day, F.lit(" 00:00:00"))).otherwise("not a time")
    return o.select("o_orderkey", F.unix_millis(scalars.parse_datetime(text)).alias("ms"))


@query("percent_encode", "SELECT event_id, '%7B%22k%22%3A%20' || regexp_extract(props, '[0-9]+') || '%7D%20~%2F%2A%2B' AS encoded FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", scalars.percent_encode(F.concat("props", F.lit(" ~/*+"))).alias("encoded"))


@query("key_value_rows", """SELECT list_value('k' || event_id, event_type) AS fields, 'INSERT' AS _kind FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT list_value('k' || event_id, f, v), 'INSERT' FROM (SELECT event_id, unnest(['a', 'b']) AS f, unnest([event_type, 'x']) AS v FROM events WHERE event_id % 3 = 1)
  UNION ALL SELECT list_value('k' || event_id, v), 'INSERT' FROM (SELECT event_id, unnest([event_type, 'a']) AS v FROM events WHERE event_id % 3 = 2)""")
def _(s, d):
    e, k = table(s, d, "events"), F.col("event_id") % 3
    made = e.select(
        F.concat(F.lit("k"), "event_id").alias("key"), F.element_at(F.array(F.lit("string"), F.lit("hash"), F.lit("set")), (k + 1).cast("int")).alias("type"), F.col("event_type").alias("text"),
        F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("event_type")).alias("map"), F.array("event_type", F.lit("a")).alias("items"), F.create_map(F.lit("m"), F.lit(1.0)).alias("scores"),
    )
    return cdc.key_value_rows(made)


@query("search_rows", "SELECT list_value('id-' || event_id, event_type, CAST(event_id AS VARCHAR)) AS fields, 'INSERT' AS _kind FROM events")
def _(s, d):
    e = table(s, d, "events")
    return cdc.search_rows(e.select(F.concat(F.lit("id-"), "event_id").alias("_id"), F.to_json(F.struct(F.col("event_id").alias("z"), F.col("event_type").alias("a"))).alias("_source")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job in small: messages are decoded, filtered, applied to a table and routed."""
    message = _json(op=_op("c", "u", "d"), after=_ROW(), before=_ROW())
    decoded = codecs.decode(_message(spark, sf_dir, message), "m", SPEC, "debezium-json")
    kept = filters.filter_by_index(decoded, 2, ">", 10)
    return changelog.apply_changelog(_base(spark, sf_dir), kept, ["user_id"], changelog.JDBC)


REGISTRY["flagship"] = (flagship, f"""WITH {CHANGES}, {_BASE}, d AS (SELECT * FROM c WHERE coalesce(value > 10, false)),
  l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1)
  SELECT user_id, name, value, flag FROM b WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, name, value, flag FROM l WHERE _kind <> 'DELETE'""")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
