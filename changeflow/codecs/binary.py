"""The two binary wire formats, in Arrow batches: neither is what its name says, so Spark's own functions don't apply.

`avro`: five bytes of header (zero, then a big-endian 1), then bigints as 8 bytes and everything else as a
little-endian length and UTF-8, in the table's order. `protobuf`: tagged fields, numbered from 1, written as text of
wire type 2 and read as wire types 0 and 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changeflow.functions.display import display
from changeflow.model import INSERT, META, TableSpec, data_columns

HEADER = b"\x00" + (1).to_bytes(4, "big")


def _wire_types(spec: TableSpec) -> list[str]:
    return [c.type if c.type in ("bigint", "boolean") else "string" for c in spec.columns]


def read_avro(data: bytes, kinds: list[str]) -> list | None:
    """None if there is no header. A field that would end beyond the message is null and takes no bytes."""
    if len(data) < len(HEADER):
        return None
    out, at = [], len(HEADER)
    for kind in kinds:
        value = None
        if at < len(data):
            if kind == "bigint":
                if at + 8 <= len(data):
                    value = int.from_bytes(data[at : at + 8], "little", signed=True)
                    at += 8
            elif at + 4 <= len(data):
                n = int.from_bytes(data[at : at + 4], "little")
                at += 4
                if at + n <= len(data):
                    value = data[at : at + n].decode("utf-8", "replace")
                    at += n
        out.append(value)
    return out


def write_avro(values: list, kinds: list[str]) -> bytes:
    """A bigint that is null is left out; other nulls are empty text."""
    parts = [HEADER]
    for value, kind in zip(values, kinds, strict=False):
        if kind == "bigint":
            if value is not None:
                parts.append(int(value).to_bytes(8, "little", signed=True))
        else:
            raw = ("" if value is None else str(value)).encode()
            parts += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(parts)


def _varint(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def _take_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("varint cut off")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & (1 << 64) - 1, at
        shift += 7


def read_protobuf(data: bytes, kinds: list[str]) -> list | None:
    """None if a varint is cut off. Reading ends at an unknown field number; other wire types are null."""
    out: list = [None] * len(kinds)
    at = 0
    try:
        while at < len(data):
            tag, at = _take_varint(data, at)
            number, wire = (tag >> 3) - 1, tag & 7
            if at >= len(data) or not 0 <= number < len(kinds):
                break
            kind, value = kinds[number], None
            if wire == 0:
                raw, at = _take_varint(data, at)
                signed = raw - (1 << 64) if raw >> 63 else raw
                value = bool(raw) if kind == "boolean" else signed if kind == "bigint" else str(signed)
            elif wire == 2:
                n, begin = _take_varint(data, at)
                if begin + n <= len(data):
                    word, at = data[begin : begin + n].decode("utf-8", "replace"), begin + n
                    if kind == "bigint":
                        value = int(word) if word.removeprefix("-").removeprefix("+").isdecimal() and word.isascii() else None
                    else:
                        value = word.lower() in ("true", "1") if kind == "boolean" else word
            out[number] = value
    except ValueError:
        return None
    return out


def write_protobuf(values: list, kinds: list[str]) -> bytes:
    parts = []
    for i, value in enumerate(values[: len(kinds)]):
        raw = ("" if value is None else str(value)).encode()
        parts += [_varint((i + 1) << 3 | 2), _varint(len(raw)), raw]
    return b"".join(parts)


def _decoder(df: DataFrame, column: str, spec: TableSpec, read) -> DataFrame:
    kinds = _wire_types(spec)
    schema = T.StructType([T.StructField(c.name, T.StructType.fromDDL(f"x {k}")[0].dataType) for c, k in zip(spec.columns, kinds, strict=True)])
    schema = T.StructType([*schema, *T.StructType.fromDDL("_kind string, _origin string, _seq bigint, _turn int")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, origin, seq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                got = read(raw, kinds) if raw is not None else None
                if got is not None:
                    rows.append((*got, INSERT, origin, seq, 0))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    origin = F.col("_origin") if "_origin" in df.columns else F.lit(None).cast("string")
    seq = F.col("_seq") if "_seq" in df.columns else F.monotonically_increasing_id()
    return df.select(F.col(column).cast("binary"), origin.alias("_origin"), seq.alias("_seq")).mapInArrow(run, schema)


def _encoder(df: DataFrame, spec: TableSpec, write) -> DataFrame:
    kinds = _wire_types(spec)
    own = data_columns(df)[: len(spec.columns)]
    meta = [c for c in META if c in df.columns]
    shown = [F.col(f"`{n}`") if k == "bigint" else display(F.col(f"`{n}`"), df.schema[n].dataType) for n, k in zip(own, kinds, strict=False)]
    flat = df.select(*meta, *[c.alias(f"_{i}") for i, c in enumerate(shown)])
    schema = T.StructType([*[df.schema[c] for c in meta], T.StructField("message", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c.to_pylist() for c in batch.columns[len(meta) :]]
            messages = [write(list(values), kinds) for values in zip(*data, strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns[: len(meta)], arrow, strict=False)], pa.array(messages, pa.binary())], schema=arrow)

    return flat.mapInArrow(run, schema)


def decode_avro(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    return _decoder(df, column, spec, read_avro)


def encode_avro(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _encoder(df, spec, write_avro)


def decode_protobuf(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    return _decoder(df, column, spec, read_protobuf)


def encode_protobuf(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _encoder(df, spec, write_protobuf)
