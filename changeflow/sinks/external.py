"""Writers for external systems. What is sent is built by column expressions (see operators.changelog and
operators.routing); only the sending needs a service, and happens per partition on executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.model import TableSpec
from changeflow.operators.changelog import JDBC, latest_by_key
from changeflow.operators.changelog import effective
from changeflow.operators.routing import console_lines, messages, payload
from changeflow.schema.dialects import Dialect


def console(df: DataFrame, prefix: str = "[console] ") -> None:
    """Prints every row; the driver holds one partition's lines at a time."""
    for row in console_lines(df, prefix).toLocalIterator():
        print(row["line"])


def kafka(df: DataFrame, servers: str, topic: str, routes=(), keys=(), fmt: str = "json", delimiter: str = ",", **producer: str) -> None:
    options = {f"kafka.{k}": v for k, v in producer.items()}
    messages(df, topic, routes, keys, fmt, delimiter).write.format("kafka").option("kafka.bootstrap.servers", servers).options(**options).save()


def statements(changes: DataFrame, spec: TableSpec, dialect: Dialect, batch_size: int = 1000) -> DataFrame:
    """`sql`, `n`: how many rows each statement covers, from the last change of each key. What a JDBC writer would prepare."""
    keys = spec.primary_key
    acts = effective(latest_by_key(changes, keys) if keys else changes, JDBC)
    key_columns = [c for c in spec.columns if c.primary_key]
    put = dialect.upsert(spec.identifier, list(spec.columns), keys) if keys else dialect.insert(spec.identifier, list(spec.columns))
    out = F.when(F.col("_op") == "upsert", put)
    if keys:
        out = out.when(F.col("_op") == "delete", dialect.delete(spec.identifier, key_columns))
    return acts.select(out.alias("sql")).filter("sql is not null").groupBy("sql").agg(F.count("*").alias("n"), F.ceil(F.count("*") / batch_size).alias("batches"))


def with_retries(send: Callable[[], None], most: int = 3, pause: float = 0.2) -> None:
    for turn in range(most + 1):
        try:
            return send()
        except Exception:
            if turn == most:
                raise
            time.sleep(pause * (turn + 1))


def http_bodies(df: DataFrame, batch: int = 1, fmt: str = "json-array") -> DataFrame:
    """`body`: one row's array each, or batches of rows of a partition as a JSON array or as lines."""
    rows = df.select(payload(df).alias("row"))
    if batch <= 1:
        return rows.select(F.col("row").alias("body"))

    def joined(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list[str] = []
        shut = lambda some: "[" + ",".join(some) + "]" if fmt == "json-array" else "\n".join(some) + "\n"
        for frame in batches:
            held += frame["row"].tolist()
            full = len(held) - len(held) % batch
            if full:
                yield pd.DataFrame({"body": [shut(held[k : k + batch]) for k in range(0, full, batch)]})
                held = held[full:]
        if held:
            yield pd.DataFrame({"body": [shut(held)]})

    return rows.mapInPandas(joined, "body string")


def http(df: DataFrame, url: str, method: str = "POST", batch: int = 1, fmt: str = "json-array", headers: dict[str, str] | None = None, retries: int = 3) -> None:
    sent = {"Content-Type": "application/json"} | (headers or {})

    def send(rows: Iterator) -> None:
        for row in rows:
            request = urllib.request.Request(url, data=row["body"].encode(), method=method, headers=sent)
            with_retries(lambda: urllib.request.urlopen(request, timeout=30).close(), retries)

    http_bodies(df, batch, fmt).foreachPartition(send)


def bulk(lines: DataFrame, url: str, most: int = 100, retries: int = 3) -> None:
    """Sends the lines of `bulk_lines` in requests of `most` actions. All actions on one id are sent by one task, in order;
    those without an id are spread."""

    def send(rows: Iterator) -> None:
        held: list[str] = []

        def flush() -> None:
            body = "".join(held).encode()
            request = urllib.request.Request(f"{url}/_bulk", data=body, method="POST", headers={"Content-Type": "application/x-ndjson"})
            with_retries(lambda: urllib.request.urlopen(request, timeout=30).close(), retries)
            held.clear()

        for row in rows:
            held.append(row["lines"])
            if len(held) >= most:
                flush()
        if held:
            flush()

    head = F.substring_index("lines", "\n", 1)
    ident = F.coalesce(*[F.get_json_object(head, f"$.{act}._id") for act in ("update", "delete", "index")])
    spread = F.coalesce(F.xxhash64(ident), F.col("_seq"))
    lines.repartition(spread).sortWithinPartitions("_seq").foreachPartition(send)


def clickhouse(changes: DataFrame, url: str, table: str, batch: int = 10_000, retries: int = 3, headers: dict[str, str] | None = None) -> None:
    """Inserts the rows as lines over the column store's HTTP interface, `batch` rows a request."""
    from urllib.parse import quote

    from changeflow.operators.changelog import json_each_row

    at = f"{url.rstrip('/')}/?query={quote(f'INSERT INTO {table} FORMAT JSONEachRow')}"

    def send(rows: Iterator) -> None:
        held: list[str] = []

        def flush() -> None:
            request = urllib.request.Request(at, data=("\n".join(held) + "\n").encode(), method="POST", headers=headers or {})
            with_retries(lambda: urllib.request.urlopen(request, timeout=60).close(), retries)
            held.clear()

        for row in rows:
            held.append(row["line"])
            if len(held) >= batch:
                flush()
        if held:
            flush()

    json_each_row(changes).sortWithinPartitions("_seq").foreachPartition(send)


def redis(changes: DataFrame, options: dict, data_type: str = "string", key: str = "${f0}", field: str = "${f1}", value: str | None = None) -> None:
    """Sends a key-value store's commands; all on one key by one task, in order."""
    from changeflow.operators.changelog import redis_commands
    from changeflow.sources.redis import send_commands

    redis_commands(changes, data_type, key, field, value).repartition("key").sortWithinPartitions("_seq").foreachPartition(lambda rows: send_commands(rows, options))
