"""How values are written as text in keys, templates, delimited lines and envelopes. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_double(x: Column) -> Column:
    """A double without exponent or superfluous zeros: 1.0 is `1`, 0.5 is `0.5`."""
    text = x.cast("string")
    # Spark writes exponents outside 1e-3 to 1e7: those go by way of a decimal.
    exact = F.regexp_replace(F.format_string("%.17f", x.cast("decimal(38,17)")), r"\.?0+$", "")
    short = F.regexp_replace(text, r"\.0$", "")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(F.contains(text, F.lit("E")), F.coalesce(exact, text)).otherwise(short)


def display(x: Column, kind: T.DataType, quote: bool = False) -> Column:
    """Text of a non-null value; null stays null. quote: strings in double quotes, as inside arrays and rows."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit('"'), x, F.lit('"')) if quote else x
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("0x"), F.lower(F.hex(x)))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_double(x.cast("double")) if isinstance(kind, T.DoubleType) else plain_double(x)
    if isinstance(kind, T.TimestampType):
        return F.concat(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), fraction(x), F.lit(" UTC"))
    if isinstance(kind, T.TimestampNTZType):
        return F.concat(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), fraction(x))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(x, lambda v: F.coalesce(display(v, kind.elementType, True), F.lit("NULL")))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if isinstance(kind, T.StructType):
        parts = [F.coalesce(display(x[f.name], f.dataType, True), F.lit("NULL")) for f in kind.fields]
        return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))
    return x.cast("string")


def fraction(x: Column) -> Column:
    """`.123` or `.123456` where there are fractions of a second, else nothing."""
    digits = F.date_format(x, "SSSSSS")
    return F.when(digits == "000000", "").when(F.endswith(digits, F.lit("000")), F.concat(F.lit("."), F.substring(digits, 1, 3))).otherwise(F.concat(F.lit("."), digits))


def json_value(x: Column, kind: T.DataType, bytes_as: str = "hex", others: str = "typed") -> Column:
    """JSON text of a value; `null` for null. bytes_as: hex, 0x or base64.

    others: `typed` (numbers stay numbers) or `text` (what isn't null, boolean, bigint or string becomes a string)."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    if isinstance(kind, T.BooleanType):
        out = x.cast("string")
    elif isinstance(kind, T.LongType) or others == "typed" and isinstance(kind, T.IntegralType):
        out = x.cast("string")
    elif isinstance(kind, T.StringType):
        out = quoted(x)
    elif others == "text":
        out = quoted(display(x, kind))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(F.to_json(F.array(x.cast("double"))).substr(F.lit(2), F.length(F.to_json(F.array(x.cast("double")))) - 2))
    elif isinstance(kind, T.BinaryType):
        out = quoted({"hex": F.lower(F.hex(x)), "0x": F.concat(F.lit("0x"), F.lower(F.hex(x))), "base64": F.base64(x)}[bytes_as])
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: json_value(v, kind.elementType, bytes_as, others)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"f{i}":'), json_value(x[f.name], f.dataType, bytes_as, others)) for i, f in enumerate(kind.fields)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        out = quoted(display(x, kind))
    return F.coalesce(out, F.lit("null"))


def json_object(parts: dict[str, Column]) -> Column:
    """An object of JSON texts; keys in alphabetical order, as all encoders write them."""
    import json

    inner = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), v) for k, v in sorted(parts.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def json_array(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
