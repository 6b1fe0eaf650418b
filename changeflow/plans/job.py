"""Jobs: each pipeline of a JobSpec becomes one lazy DataFrame plan with its sinks, run once or as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from changeflow.model import ColumnSpec, TableSpec, as_changes, type_name
from changeflow.operators import transforms as T
from changeflow.operators.changelog import POLICIES, bulk_lines
from changeflow.operators.filters import filter_by_index
from changeflow.operators.routing import TableSelector
from changeflow.plans.config import ConfigError, JobSpec, Pipeline, Plugin, Rules
from changeflow.sinks import dbapi, external, tables
from changeflow.sources import catalog, cdc, connect, fake
from changeflow.sources import http as http_source
from changeflow.sources import redis as redis_source
from changeflow.streaming import fanout


def _names(value: str | None) -> list[str]:
    return [k.strip() for k in (value or "").split(",") if k.strip()]


def table_spec(options: dict, identifier: str = "") -> TableSpec | None:
    """`columns` (or schema.fields): names and types; `primary-keys`: names."""
    found = options.get("columns") or (options.get("schema") or {}).get("fields")
    if not found:
        return None
    pairs = found.items() if isinstance(found, dict) else [(c["name"], c.get("type", "string")) if isinstance(c, dict) else (c, "string") for c in found]
    keys = options.get("primary-keys") or options.get("primary_keys") or ""
    keys = keys if isinstance(keys, list) else _names(str(keys))
    return TableSpec(str(options.get("table") or options.get("result_table_name") or identifier), tuple(ColumnSpec(n, type_name(t), n not in keys, n in keys) for n, t in pairs))


def _files(spark: SparkSession, plugin: Plugin, streaming: bool, _: int) -> DataFrame:
    o = plugin.flat
    if streaming:
        spec = table_spec(plugin.options)
        if spec is None:
            raise ConfigError(f"{plugin.name}: a stream of files needs columns")
        df = spark.readStream.schema(spec.struct).format(o.get("format", "parquet")).load(o["path"])
    else:
        df = spark.read.format(o.get("format", "parquet")).load(o["path"])
    return df if "_kind" in df.columns else as_changes(df)


def _fake(spark: SparkSession, plugin: Plugin, streaming: bool, parallelism: int) -> DataFrame:
    rows = int(plugin.flat.get("row.num", 10))
    return fake.stream(spark, rows, max(1, int(1000 / max(int(plugin.flat.get("sleep.ms", 1)), 1)))) if streaming else fake.rows(spark, rows).repartition(max(parallelism, 1))


def _jdbc(spark: SparkSession, plugin: Plugin, _: bool, parallelism: int) -> DataFrame:
    o = dict(plugin.flat)
    o.setdefault("partition.num", str(parallelism))
    return as_changes(connect.jdbc(o, connect.jdbc_bounds(spark, o)).load(spark))


def _kafka(spark: SparkSession, plugin: Plugin, streaming: bool, _: int) -> DataFrame:
    o = plugin.flat
    raw = connect.kafka(o, streaming).load(spark)
    return kafka_rows(raw, plugin)


def kafka_rows(raw: DataFrame, plugin: Plugin) -> DataFrame:
    """Messages of topics as changes, decoded by `format` with the configured columns; `_seq` is the offset."""
    told = raw.withColumn("_seq", F.col("offset").cast("bigint")).withColumn("_origin", F.col("topic"))
    return cdc.read_messages(told, "value", table_spec(plugin.options), plugin.flat.get("format", "json"))


def _cdc(default: str, updates: str) -> Callable:
    """A change source, fed by messages: of a topic, or of files (lines of text, or Parquet with `value` and `offset`)."""

    def make(spark: SparkSession, plugin: Plugin, streaming: bool, _: int) -> DataFrame:
        o = plugin.flat
        spec = table_spec(plugin.options)
        if spec is None or not (o.get("messages") or o.get("topic")):
            raise ConfigError(f"{plugin.name}: needs columns, and change messages from `messages` (a path) or `topic` with bootstrap.servers; logs of databases aren't read")
        if o.get("topic"):
            raw = connect.kafka(o | {"startup.mode": "earliest"}, streaming).load(spark)
        else:
            read = spark.readStream if streaming else spark.read
            raw = read.schema("value string, offset long").parquet(o["messages"]) if o.get("messages.format") == "parquet" else read.text(o["messages"])
        many = lambda *names: tuple(n for k in names for n in _names(o.get(k)))
        chosen = TableSelector(many("database-names", "database-name"), o.get("database-pattern"), many("table-names"), many("table-pattern", "table-patterns"))
        mode, stop = o.get("startup.mode", "initial"), o.get("stop.mode", "never")
        number = lambda k: int(o[k]) if o.get(k) else None
        changes = cdc.change_messages(
            raw, spec, o.get("format", default), "value", chosen if chosen != TableSelector() else None, mode, stop, number("startup.timestamp"), number("stop.timestamp"), number("startup.seq"), number("stop.seq"), updates,
        )
        if cdc.STARTUP[mode.lower()] in ("initial", "snapshot") and o.get("snapshot") and not streaming:
            snapshot = as_changes(spark.read.parquet(o["snapshot"]).select(*spec.names), seq=F.lit(number("snapshot.seq") or -1))
            return cdc.hand_over(snapshot, changes, spec.primary_key, number("snapshot.seq") or -1)
        return changes

    return make


def _http(spark: SparkSession, plugin: Plugin, streaming: bool, _: int) -> DataFrame:
    spark.dataSource.register(http_source.HttpSource)
    return as_changes(connect.http(plugin.flat if streaming else plugin.flat | {"poll-interval-ms": 0}).load(spark))


def _redis(spark: SparkSession, plugin: Plugin, _: bool, __: int) -> DataFrame:
    spark.dataSource.register(redis_source.RedisSource)
    return as_changes(connect.redis(plugin.flat).load(spark))


def _reader(build: Callable) -> Callable:
    return lambda spark, plugin, streaming, parallelism: as_changes(build(plugin.flat).load(spark))


SOURCES: dict[str, Callable[[SparkSession, Plugin, bool, int], DataFrame]] = {
    "fakesource": _fake, "fake": _fake, "files": _files, "parquet": _files, "jdbc": _jdbc, "kafka": _kafka, "clickhouse": _reader(connect.clickhouse), "elasticsearch": _reader(connect.elasticsearch),
    "redis": _redis, "http": _http, "mysqlcdc": _cdc("debezium_json", "both"), "postgresqlcdc": _cdc("debezium_json", "both"), "postgrescdc": _cdc("debezium_json", "both"), "tidbcdc": _cdc("canal_json", "after"),
}

#: Which options plugins must have.
RULES = {
    "source": {"jdbc": Rules(("url",), exclusive=(("table", "query"),)), "kafka": Rules(("bootstrap.servers", "topic")), "redis": Rules(("host",)), "http": Rules(("url",)), "clickhouse": Rules(exclusive=(("table", "query"),)), "elasticsearch": Rules(("hosts", "index"))},
    "sink": {"jdbc": Rules(("url", "table")), "kafka": Rules(("bootstrap.servers", "topic")), "redis": Rules(("host",)), "http": Rules(("url",)), "clickhouse": Rules(("url", "table")), "elasticsearch": Rules(("hosts", "index")), "table": Rules(("path",))},
}


def check(plugin: Plugin, what: str) -> None:
    rules = RULES[what].get(plugin.key)
    if rules and (errors := rules.errors(plugin.flat)):
        raise ConfigError(f"{what} {plugin.name}: {'; '.join(errors)}")


def source(spark: SparkSession, plugin: Plugin, streaming: bool = False, parallelism: int = 1) -> DataFrame:
    make = SOURCES.get(plugin.key)
    if make is None:
        raise ConfigError(f"unknown source plugin {plugin.name!r} (supported: {', '.join(SOURCES)})")
    check(plugin, "source")
    return make(spark, plugin, streaming, parallelism)


def transform(plugin: Plugin) -> T.Transform:
    o = plugin.options
    name = plugin.key
    if name == "filter":
        return lambda df: filter_by_index(df, int(o["field_index"]), str(o.get("operator", "not_null")), o.get("value"))
    if name == "fanout":
        return T.fanout(str(o.get("mode", "all")), int(o.get("n", o.get("index", 0))))
    if name == "rename":
        return T.rename(list(o["fields"].items()) if isinstance(o["fields"], dict) else [tuple(p) for p in o["fields"]])
    if name == "select":
        return T.select([int(i) for i in o["indexes"]])
    if name == "sql":
        return T.sql(o["query"], o.get("view", "source"))
    raise ConfigError(f"unknown transform plugin {plugin.name!r} (supported: filter, fanout, rename, select, sql)")


def sink(spark: SparkSession, plugin: Plugin, name: str = "") -> fanout.Write:
    """name: the run whose batches these are; a table takes each of them once."""
    o = plugin.flat
    check(plugin, "sink")
    if plugin.key == "console":
        return lambda df, _: external.console(df)
    if plugin.key in ("table", "files", "parquet"):
        keys = _names(o.get("primary-keys"))
        target = tables.TableSink(tables.VersionedTable(spark, o["path"]), keys, POLICIES[o.get("policy", "jdbc")], run=name, buckets=int(o.get("buckets", tables.BUCKETS)))
        target.open(o.get("schema-save-mode", "CREATE_SCHEMA_WHEN_NOT_EXIST"), o.get("data-save-mode", "APPEND_DATA"))
        return target.write
    if plugin.key == "jdbc":
        who = {"user": o.get("username") or o.get("user"), "password": o.get("password")}
        own = table_spec(plugin.options, o["table"]) or catalog.Catalog(o["url"], **who).spec(o["table"])
        if own is None:
            raise ConfigError("sink jdbc: needs columns, or a table that is there")
        dbapi.open_table(o["url"], own, o.get("schema-save-mode", "CREATE_SCHEMA_WHEN_NOT_EXIST"), o.get("data-save-mode", "APPEND_DATA"), o.get("custom-sql"), **who)
        return lambda df, _: dbapi.write(df, own, o["url"], int(o.get("batch-size", 1000)), int(o.get("connections", 8)), **who)
    if plugin.key == "kafka":
        routes = [(r["pattern"], r["topic"]) for r in plugin.options.get("topic-routes", [])]
        return lambda df, _: external.kafka(df, o["bootstrap.servers"], o["topic"], routes, _names(o.get("partition-key-fields")), o.get("format", "json"), o.get("field.delimiter", ","))
    if plugin.key == "http":
        return lambda df, _: external.http(df, o["url"], o.get("method", "POST"), int(o.get("max-batch-size", 1)), o.get("batch-format", "json-array"))
    if plugin.key == "elasticsearch":
        url = o["hosts"] if "://" in o["hosts"] else f"http://{o['hosts']}"
        return lambda df, _: external.bulk(bulk_lines(df, _names(o.get("primary-keys")), o["index"], o.get("enable-delete", "true").lower() == "true", o.get("key-delimiter", "_")), url, int(o.get("max-batch-size", 100)))
    if plugin.key == "clickhouse":
        return lambda df, _: external.clickhouse(df, o["url"], o["table"], int(o.get("batch-size", 10_000)))
    if plugin.key == "redis":
        at = connect.redis(o).options
        return lambda df, _: external.redis(df, at, o.get("data-type", "string"), o.get("key", "${f0}"), o.get("field", "${f1}"), o.get("value"))
    raise ConfigError(f"unknown sink plugin {plugin.name!r} (supported: console, table, jdbc, kafka, http, elasticsearch, clickhouse, redis)")


def plan(spark: SparkSession, pipeline: Pipeline, streaming: bool = False) -> DataFrame:
    """The pipeline's rows before its sinks; nothing runs yet."""
    return T.compose([transform(t) for t in pipeline.transforms])(source(spark, pipeline.source, streaming, pipeline.parallelism))


def _sinks(spark: SparkSession, p: Pipeline, name: str) -> dict[str, fanout.Write]:
    return {f"{s.name}#{i}": sink(spark, s, name) for i, s in enumerate(p.sinks)}


def run(spark: SparkSession, spec: JobSpec, batch: int = 0, name: str | None = None) -> dict[str, dict[str, str]]:
    """Runs each pipeline once; the sinks that failed, by pipeline. name: of this run; a run that is given the name of an
    earlier one repeats it, and tables take nothing twice. Without a name, each run is its own."""
    name, out = name or uuid.uuid4().hex, {}
    for p in spec.pipelines:
        mux = fanout.FanOut(_sinks(spark, p, f"{name}/{p.name}"), on_failure=p.on_sink_failure)
        mux(plan(spark, p), batch)
        out[p.name] = mux.dead
    return out


def stream(spark: SparkSession, spec: JobSpec, checkpoint: str, bounded: bool = False) -> dict[str, StreamingQuery]:
    """Starts each pipeline as a stream with a checkpoint of its own below `checkpoint`, a batch every checkpoint.interval.
    bounded: what is there now is read, and the queries end."""
    interval = None if bounded else f"{spec.checkpoint_interval_ms or 1000} milliseconds"
    out = {}
    for p in spec.pipelines:
        own = f"{checkpoint.rstrip('/')}/{p.name}"
        out[p.name] = fanout.run(source(spark, p.source, True, p.parallelism), [transform(t) for t in p.transforms], _sinks(spark, p, own), own, interval, p.on_sink_failure)
    return out


def explain(spark: SparkSession, spec: JobSpec) -> str:
    parts = []
    for p in spec.pipelines:
        df = plan(spark, p)
        parts.append(f"== {p.name} ==\n{df._jdf.queryExecution().toString()}")
    return "\n".join(parts)
