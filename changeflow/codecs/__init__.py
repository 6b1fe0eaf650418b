"""Message formats by name: decode(df, column, spec) gives a change frame, encode(df, spec) a frame with `message`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from changeflow.codecs import binary, envelopes, text
from changeflow.model import TableSpec

_DECODE = {
    "json": envelopes.decode_json, "compatible_debezium_json": envelopes.decode_json, "native": envelopes.decode_native, "canal_json": envelopes.decode_canal,
    "debezium_json": envelopes.decode_debezium, "maxwell_json": envelopes.decode_maxwell, "ogg_json": envelopes.decode_ogg,
    "compatible_kafka_connect_json": envelopes.decode_connect, "canal_client_json": envelopes.decode_canal_client, "text": text.decode, "avro": binary.decode_avro, "protobuf": binary.decode_protobuf,
}
_ENCODE = {
    "json": envelopes.encode_json, "compatible_debezium_json": envelopes.encode_compatible, "native": envelopes.encode_native, "canal_json": envelopes.encode_canal,
    "debezium_json": envelopes.encode_debezium, "maxwell_json": envelopes.encode_maxwell, "ogg_json": envelopes.encode_ogg,
    "compatible_kafka_connect_json": envelopes.encode_connect, "text": text.encode, "avro": binary.encode_avro, "protobuf": binary.encode_protobuf,
}
FORMATS = tuple(_DECODE)


def format_name(name: str) -> str:
    low = name.strip().lower().replace("-", "_")
    low = {"canal": "canal_json", "debezium": "debezium_json", "maxwell": "maxwell_json", "ogg": "ogg_json", "kafka_connect_json": "compatible_kafka_connect_json", "canal_client": "canal_client_json"}.get(low, low)
    if low not in _DECODE:
        raise ValueError(f"unknown format {name!r}")
    return low


def decode(df: DataFrame, column: str, spec: TableSpec, fmt: str = "json", first_only: bool = False) -> DataFrame:
    """Rows of the messages in a column; messages that aren't of the format give none. first_only: an update's first row alone."""
    got = _DECODE[format_name(fmt)](df, column, spec)
    return got.filter("_turn = 0").drop("_turn") if first_only else got.drop("_turn")


def encode(df: DataFrame, spec: TableSpec, fmt: str = "json", **options) -> DataFrame:
    """The change frame's metadata and `message`."""
    return _ENCODE[format_name(fmt)](df, spec, **options)
