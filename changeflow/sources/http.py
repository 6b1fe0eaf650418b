"""An HTTP source in the Python Data Source API: one request (batch) or one per trigger (stream)."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader


def fetch(options: dict) -> str:
    """The response's text; 429 and 5xx are tried again, with growing pauses."""
    headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
    body = options.get("body")
    for turn in range(int(options.get("retries", 3)) + 1):
        request = urllib.request.Request(options["url"], data=body.encode() if body else None, method=options.get("method", "GET"), headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=30) as got:
                return got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or turn == int(options.get("retries", 3)):
                raise
        time.sleep(int(options.get("backoff", 200)) * (turn + 1) / 1000)
    raise RuntimeError("unreachable")


def rows_of(text: str, path: str = "") -> list[list[str | None]]:
    """Rows of texts: an array's elements, or one row; an object's values in order of its keys."""
    value = json.loads(text)
    for step in filter(None, path.split(".")):
        value = (value[int(step)] if step.isdigit() and int(step) < len(value) else None) if isinstance(value, list) else value.get(step) if isinstance(value, dict) else None
    shown = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    row = lambda v: [shown(v[k]) for k in sorted(v)] if isinstance(v, dict) else [shown(v)]
    return [] if value is None else [row(v) for v in value] if isinstance(value, list) else [row(value)]


class _Once(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, _):
        for fields in rows_of(fetch(self.options), self.options.get("path", "")):
            yield (fields,)


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict):
        rows = [(f,) for f in rows_of(fetch(self.options), self.options.get("path", ""))]
        return iter(rows), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(f,) for f in rows_of(fetch(self.options), self.options.get("path", ""))])

    def commit(self, end: dict) -> None:
        pass


class HttpSource(DataSource):
    """`fields array<string>`, one row per record."""

    @classmethod
    def name(cls) -> str:
        return "changeflow-http"

    def schema(self) -> str:
        return "fields array<string>"

    def reader(self, schema) -> _Once:
        return _Once(dict(self.options))

    def simpleStreamReader(self, schema) -> _Poll:
        return _Poll(dict(self.options))
