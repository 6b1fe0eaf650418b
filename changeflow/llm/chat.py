r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: per turn a header `### Role:`, the text, and a closing `</turn>`, each on a line of its
own. Where a text holds the beginning of a header (`### `) or `</turn>`, one backslash more is put before it and before
the backslashes that are there already; taking one away again undoes that. The rendered string is encoded once with
character offsets, and each assistant turn's span is intersected with the sorted token spans by binary search: tokens
first to last bear loss, and within them the characters of the span.

Rows are brought together by conversation and sorted by turn; a task holds one conversation at a time.

Defined results: a null text or role is empty; ties of turn are ordered by role, then text; null ids form one
conversation; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import arrow_batches

ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_SAID = {v: k for k, v in ROLES.items()}
_escape = re.compile(r"(\\*)(### |</turn>)").sub
_unescape = re.compile(r"\\(\\*)(### |</turn>)").sub
_turn = re.compile(r'### (User|Assistant|System|"(?:[^"\\]|\\.)*"):\n(.*?)\n(?<!\\)</turn>\n', re.S)
LOSS = "assistant"


def escape(text: str) -> str:
    return _escape(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _unescape(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {ROLES.get(role) or json.dumps(role)}:\n", escape(text)
        if role == LOSS:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}\n</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(_SAID.get(m[1]) or json.loads(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def align(spans: list[tuple[int, int]], ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """ends: where tokens end, ascending; each begins where the one before ends. Token ranges [first, last) and what of
    each span they cover."""
    tokens, covered = [], []
    for start, end in spans:
        first, last = bisect_right(ends, start), bisect_left(ends, end) + 1
        if start == end or first >= len(ends):
            tokens.append((first, first))
            covered.append((start, start))
            continue
        last = min(last, len(ends))
        tokens.append((first, last))
        covered.append((max(start, ends[first - 1] if first else 0), min(end, ends[last - 1])))
    return tokens, covered


_PAIR = "array<struct<a:long,b:long>>"
_SCHEMA = f"key long, n_turns long, formatted string, ids array<int>, loss_tokens {_PAIR}, loss_spans {_PAIR}"


def _formatter(path: str):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        schema = pa.schema([("key", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_tokens", pair), ("loss_spans", pair)])

        def done(key: int | None, turns: list[tuple[str, str]]) -> tuple:
            text, spans = render(turns)
            got = tokenizer.encode(text, add_special_tokens=False)
            ends, last = [], 0
            for _, e in got.offsets:
                last = max(last, e)
                ends.append(last)
            if ends:
                ends[-1] = len(text)
            tokens, covered = align(spans, ends)
            as_pairs = lambda xs: [{"a": a, "b": b} for a, b in xs]
            return key, len(turns), text, got.ids, as_pairs(tokens), as_pairs(covered)

        rows, key, turns = [], None, []
        for batch in batches:
            for k, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if turns and k != key:
                    rows.append(done(key, turns))
                    turns = []
                key = k
                turns.append((role or "", text or ""))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if turns:
            rows.append(done(key, turns))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return form


def format_conversations(turns: DataFrame, tokenizer: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, n_turns, formatted, ids, loss_tokens ([a, b) of ids), loss_spans ([a, b) of formatted).

    tokenizer: the path of a byte-level tokenizer's file on every executor."""
    arrow_batches(turns.sparkSession)
    rows = turns.select(F.col(key).cast("bigint").alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    met = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    return met.mapInArrow(_formatter(tokenizer), _SCHEMA).withColumnRenamed("key", key)
