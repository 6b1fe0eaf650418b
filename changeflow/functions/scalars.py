"""Scalar functions of the reference surface as column expressions (or plan-time text functions where they act on names)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_case(name: str) -> str:
    """`l_class_student` becomes `lClassStudent`; a plan-time function on names."""
    return re.sub("_+([^_]?)", lambda m: m[1].upper(), name)


def truncate_text(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def squeeze_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def percent_encode(text: Column) -> Column:
    """All bytes but letters, digits and `-._~` as %XX; `/` becomes %2F."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def tso_of_millis(ms: Column) -> Column:
    """A timestamp oracle's number: milliseconds shifted by the 18 bits of its logical part."""
    return F.shiftleft(ms.cast("bigint"), 18)


def millis_of_tso(tso: Column) -> Column:
    return F.shiftright(tso.cast("bigint"), 18)


def chunk_size(low: Column, high: Column, parts: int) -> Column:
    """Ceiling division of a closed range into parts, at least 1."""
    return F.greatest(F.ceil((high - low + 1) / parts), F.lit(1)).cast("bigint")


def ordered_key(value: Column) -> Column:
    """Eight bytes, as hex, that sort like the signed 64-bit value: big-endian with the sign bit flipped."""
    return F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def from_ordered_key(key: Column) -> Column:
    return F.conv(key, 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def varint(value: Column) -> Column:
    """The bytes, as hex, of a 64-bit value in groups of seven bits, the low ones first; negative values take ten bytes."""
    value = value.cast("bigint")
    rest = lambda k: F.shiftrightunsigned(value, k)
    # A shift by 70 would be one by 6: nothing follows the tenth group.
    more = [F.when(rest(7 * (k + 1)) != 0, 128).otherwise(0) if k < 9 else F.lit(0) for k in range(10)]
    groups = [F.lpad(F.hex(rest(7 * k).bitwiseAND(F.lit(127)) + more[k]), 2, "0") for k in range(10)]
    return F.when(value.isNotNull(), F.concat(groups[0], *[F.when(rest(7 * k) != 0, groups[k]).otherwise("") for k in range(1, 10)]))


def from_varint(text: Column) -> Column:
    """The value of a varint's hex; bits beyond 64 are dropped."""
    total = F.lit(0).cast("bigint")
    for k in range(10):
        byte = F.coalesce(F.conv(F.nullif(F.substring(text, 2 * k + 1, 2), F.lit("")), 16, 10).cast("bigint"), F.lit(0))
        total = total.bitwiseOR(F.shiftleft(byte.bitwiseAND(F.lit(127)), 7 * k))
    return F.when(text.isNotNull(), total)


def memcomparable(value: Column) -> Column:
    """Bytes, as hex, that sort like the text's bytes even if others follow: groups of eight, each with a mark of how many
    of its bytes count (0xFF for all eight); there is always a group that isn't full."""
    digits = F.hex(value.cast("binary"))
    n = F.octet_length(value)

    def group(k: Column) -> Column:
        counted = F.least(n - 8 * k, F.lit(8))
        return F.concat(F.rpad(F.substr(digits, 16 * k + 1, F.lit(16)), 16, "0"), F.lpad(F.hex(247 + counted), 2, "0"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 8).cast("int")), group), "")


def flatten_config(config: dict, prefix: str = "") -> dict[str, str]:
    """Nested settings as dotted keys; lists of scalars comma-joined, other lists as JSON text, null as empty."""
    import json

    out: dict[str, str] = {}
    for key, value in config.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out |= flatten_config(value, f"{name}.")
        elif isinstance(value, list):
            plain = all(isinstance(v, (str, int, float, bool)) for v in value)
            out[name] = ",".join(map(_scalar, value)) if plain else json.dumps(value, separators=(",", ":"), sort_keys=True)
        else:
            out[name] = _scalar(value)
    return out


def _scalar(value) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def template(pattern: str, values: dict[str, Column]) -> Column:
    """`${name}` in a pattern replaced by columns, null as empty; names without a column stay as they are."""
    parts = []
    for piece in re.split(r"(\$\{[^}]*\})", pattern):
        name = piece[2:-1] if piece.startswith("${") else None
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(piece))
    return F.concat(*parts)


#: Forms in which datetimes are read, tried in this order.
DATETIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd")


def parse_datetime(text: Column) -> Column:
    """The first form that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATETIME_FORMS])


def datetime_text(x: Column) -> Column:
    """A date and time as a log of changes has it: the date alone at midnight."""
    from changeflow.functions.display import fraction

    time = F.concat(F.date_format(x, "HH:mm:ss"), fraction(x))
    return F.when(time == "00:00:00", F.date_format(x, "yyyy-MM-dd")).otherwise(F.concat_ws(" ", F.date_format(x, "yyyy-MM-dd"), time))


def zone(name: str | None) -> str:
    """A configured server zone as Spark's: UTC, +-HH[:MM], a region; the session's machine zone for what is none."""
    import datetime
    import zoneinfo

    text = (name or "").strip()
    if text.upper() in ("UTC", "Z", "GMT"):
        return "UTC"
    if m := re.fullmatch(r"([+-])(\d{1,2})(?::?(\d{2}))?", text):
        return f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}"
    try:
        return zoneinfo.ZoneInfo(text).key if text else _local(datetime)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return _local(datetime)


def _local(datetime) -> str:
    off = datetime.datetime.now().astimezone().strftime("%z")
    return f"{off[:3]}:{off[3:]}"
