"""A key-value store's protocol (RESP) over a socket: a source in the Python Data Source API, and sending commands."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader


class Client:
    def __init__(self, host: str, port: int = 6379, db: int = 0, password: str | None = None):
        self._socket = socket.create_connection((host, int(port)), timeout=30)
        self._in = self._socket.makefile("rb")
        if password:
            self.call("AUTH", password)
        if int(db):
            self.call("SELECT", db)

    def send(self, *words) -> None:
        parts = [w if isinstance(w, bytes) else str(w).encode() for w in words]
        self._socket.sendall(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts))

    def reply(self):
        line = self._in.readline()
        if not line.endswith(b"\r\n"):
            raise ConnectionError("the connection was closed")
        kind, rest = line[:1], line[1:-2]
        if kind == b"-":
            raise RuntimeError(rest.decode())
        if kind == b"+":
            return rest.decode()
        if kind == b":":
            return int(rest)
        n = int(rest)
        if n < 0:
            return None
        if kind == b"*":
            return [self.reply() for _ in range(n)]
        return self._in.read(n + 2)[:-2].decode("utf-8", "replace")

    def call(self, *words):
        self.send(*words)
        return self.reply()

    def close(self) -> None:
        self._in.close()
        self._socket.close()


def scan(client: Client, pattern: str) -> Iterator[str]:
    """Keys, each once; a scan may return one twice."""
    cursor, seen = "0", set()
    while True:
        cursor, keys = client.call("SCAN", cursor, "MATCH", pattern, "COUNT", 1000)
        for k in keys:
            if k not in seen:
                seen.add(k)
                yield k
        if cursor == "0":
            return


def rows_of(client: Client, key: str) -> list[list[str]]:
    kind = client.call("TYPE", key)
    if kind == "string":
        return [[key, client.call("GET", key)]]
    if kind == "hash":
        flat = client.call("HGETALL", key)
        return [[key, f, v] for f, v in sorted(zip(flat[::2], flat[1::2], strict=True))]
    if kind == "list":
        return [[key, v] for v in client.call("LRANGE", key, 0, -1)]
    if kind == "set":
        return [[key, v] for v in sorted(client.call("SMEMBERS", key))]
    if kind == "zset":
        flat = client.call("ZRANGE", key, 0, -1, "WITHSCORES")
        return [[key, v, s] for v, s in zip(flat[::2], flat[1::2], strict=True)]
    return []


class _Keys(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, _):
        o = self.options
        client = Client(o["host"], o.get("port", 6379), o.get("db", 0), o.get("password"))
        try:
            for key in scan(client, o.get("keys", "*")):
                for fields in rows_of(client, key):
                    yield (fields,)
        finally:
            client.close()


class RedisSource(DataSource):
    """`fields array<string>`, as key_value_rows shapes them."""

    @classmethod
    def name(cls) -> str:
        return "changeflow-redis"

    def schema(self) -> str:
        return "fields array<string>"

    def reader(self, schema) -> _Keys:
        return _Keys(dict(self.options))


def words_of(command: str, key: str, field: str | None, value: str | None) -> list[str]:
    """The words of a command of redis_commands. Members of sorted sets get the score 0."""
    if command == "HSET":
        return [command, key, field, value]
    if command == "HDEL":
        return [command, key, field]
    if command == "LREM":
        return [command, key, "0", value]
    if command == "ZADD":
        return [command, key, "0", value]
    return [command, key] if command == "DEL" else [command, key, value]


def send_commands(rows: Iterator, options: dict, most: int = 100) -> None:
    """Sends a partition's commands in order, `most` at a time before their replies are read."""
    client, waiting = None, 0
    try:
        for row in rows:
            client = client or Client(options["host"], options.get("port", 6379), options.get("db", 0), options.get("password"))
            client.send(*words_of(row["command"], row["key"], row["field"], row["value"]))
            waiting += 1
            if waiting >= most:
                while waiting:
                    client.reply()
                    waiting -= 1
        while waiting:
            client.reply()
            waiting -= 1
    finally:
        if client:
            client.close()
