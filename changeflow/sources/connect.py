"""Readers for external systems: option checking and the Spark reader each becomes. Live services are never needed to build one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from changeflow.operators import splits


@dataclass(frozen=True)
class Reader:
    """format and options for `spark.read` or `spark.readStream`; predicates for range reads."""

    format: str
    options: dict[str, str] = field(default_factory=dict)
    predicates: tuple[str, ...] = ()
    streaming: bool = False

    def load(self, spark: SparkSession) -> DataFrame:
        if self.predicates:
            properties = {k: v for k, v in self.options.items() if k not in ("url", "dbtable")}
            return spark.read.jdbc(self.options["url"], self.options["dbtable"], predicates=list(self.predicates), properties=properties)
        return (spark.readStream if self.streaming else spark.read).format(self.format).options(**self.options).load()


def _need(config: dict, *names: str) -> str:
    for n in names:
        if config.get(n):
            return str(config[n])
    raise ValueError(f"missing option {names[0]!r}")


def jdbc(config: dict, bounds: tuple[int, int] | None = None) -> Reader:
    """A query is one partition; a table with bounds of its split column is read by ranges."""
    options = {"url": _need(config, "url"), "fetchsize": str(config.get("fetch.size") or config.get("batch.size") or config.get("fetch_size") or 1024)}
    for ours, theirs in (("username", "user"), ("user", "user"), ("password", "password"), ("driver", "driver")):
        if config.get(ours):
            options[theirs] = str(config[ours])
    if config.get("query"):
        return Reader("jdbc", options | {"query": config["query"]})
    options["dbtable"] = _need(config, "table")
    column = config.get("partition.column") or config.get("partition_column")
    if column and bounds:
        parts = int(config.get("partition.num") or config.get("partition_num") or 1)
        return Reader("jdbc", options, tuple(splits.predicates(column, *bounds, parts)))
    return Reader("jdbc", options)


def jdbc_bounds(spark: SparkSession, config: dict) -> tuple[int, int] | None:
    """The least and greatest value of the split column: one small query; null if the table is empty or has no split column."""
    column = config.get("partition.column") or config.get("partition_column")
    if not column or config.get("query"):
        return None
    whole = jdbc(config).options
    query = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {whole['dbtable']}"
    row = spark.read.format("jdbc").options(**{k: v for k, v in whole.items() if k != "dbtable"}, query=query).load().first()
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


def kafka(config: dict, streaming: bool = True) -> Reader:
    """Start modes: earliest, latest, group-offsets, timestamp, specific-offsets `p:o,p:o`."""
    import json

    topic = _need(config, "topic")
    options = {"kafka.bootstrap.servers": _need(config, "bootstrap.servers"), "subscribe": topic}
    if config.get("group.id"):
        options["kafka.group.id"] = str(config["group.id"])
    mode = str(config.get("startup.mode", "earliest")).lower().replace("_", "-")
    if mode == "timestamp":
        options["startingTimestamp"] = _need(config, "startup.timestamp")
    elif mode in ("specific", "specific-offsets"):
        pairs = [p.split(":") for p in _need(config, "startup.specific-offsets").split(",")]
        options["startingOffsets"] = json.dumps({topic: {p.strip(): int(o) for p, o in pairs}})
    elif mode in ("earliest", "latest"):
        options["startingOffsets"] = mode
    elif mode not in ("group-offsets", "group"):
        raise ValueError(f"unknown startup.mode {mode!r}")
    return Reader("kafka", options, streaming=streaming)


def clickhouse(config: dict, keys: list[str] = ()) -> Reader:
    """Keyset paging needs a single key."""
    if len(keys) > 1:
        raise ValueError("cursor reads need one primary key")
    url = config.get("url") or f"jdbc:ch://{_need(config, 'hosts')}/{config.get('database', 'default')}"
    options = {"url": url, "fetchsize": str(config.get("fetch-size", 1000))}
    return Reader("jdbc", options | ({"query": config["query"]} if config.get("query") else {"dbtable": _need(config, "table")}))


def elasticsearch(config: dict) -> Reader:
    options = {"es.nodes": _need(config, "hosts"), "es.resource": _need(config, "index"), "es.scroll.size": str(config.get("scroll-size", 100)), "es.scroll.keepalive": str(config.get("scroll-time", "1m"))}
    return Reader("org.elasticsearch.spark.sql", options | ({"es.query": str(config["query"])} if config.get("query") else {}))


def redis(config: dict) -> Reader:
    return Reader("changeflow-redis", {"host": _need(config, "host"), "port": str(config.get("port", 6379)), "keys": str(config.get("keys", "*")), "db": str(config.get("db-num", 0))} | ({"password": str(config["password"])} if config.get("password") else {}))


def http(config: dict) -> Reader:
    poll = int(config.get("poll-interval-ms", 0))
    options = {"url": _need(config, "url"), "method": str(config.get("method", "GET")).upper(), "path": str(config.get("data-path", "")), "retries": str(config.get("max-retries", 3)), "backoff": str(config.get("retry-backoff-ms", 200)), "poll": str(poll)}
    if options["method"] not in ("GET", "POST"):
        raise ValueError("method is GET or POST")
    headers = {f"header.{k[8:]}": str(v) for k, v in config.items() if k.startswith("headers.")}
    return Reader("changeflow-http", options | headers | ({"body": str(config["body"])} if config.get("body") else {}), streaming=poll > 0)
