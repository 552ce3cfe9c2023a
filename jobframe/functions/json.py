"""JSON helpers on payload text.

Payloads cross every boundary as JSON text. Type-aware reads use VARIANT
(``try_parse_json`` + ``try_variant_get`` + ``schema_of_variant``), which tells a
JSON string "42" from a number 42 – ``get_json_object`` cannot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes of the largest text that is read as a VARIANT; beyond it (a VARIANT value holds 128 MiB) a text is parsed by
#: the plain JSON reader.
VARIANT_BYTES = 100 << 20
#: Its options: a string of any length.
_LARGE = {"maxStringLen": str(2**31 - 1)}


def key_path(key: str) -> str:
    """Variant path for one top-level key, safe for any characters."""
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def json_field(payload_text: Column, key: str) -> Column:
    """Top-level field as VARIANT (NULL if absent, unparsable or not an object)."""
    return F.try_variant_get(F.try_parse_json(payload_text), key_path(key), "variant")


def top_level_string(payload_text: Column, key: str) -> Column:
    """Value of a top-level key only when it is a JSON string."""
    v = json_field(payload_text, key)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def valid_json(text: Column) -> Column:
    """Whether a text is one JSON value, whatever its size."""
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _LARGE)
    return F.when(F.octet_length(text) <= VARIANT_BYTES, F.try_parse_json(text).isNotNull()).otherwise(
        F.coalesce(F.size(items) == 1, F.lit(False)))


def string_field(text: Column, key: str) -> Column:
    """P2 for texts of any size: the value of a top-level key only when it is a JSON string."""
    name = "`" + key.replace("`", "``") + "`"
    v = F.from_json(text, f"struct<{name}: variant>", _LARGE)[key]
    large = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(F.octet_length(text) <= VARIANT_BYTES, top_level_string(text, key)).otherwise(large)


def compact_json(text: Column) -> Column:
    """JSON text without the white space outside its strings; numbers and strings stay as written."""
    return F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s++', "$1")


def float_text(d: Column) -> Column:
    """A double as the reference prints it: shortest digits, plain from 1e-5 up to 1e16 (always with a fraction),
    else with a bare exponent (``1.0``, ``1e300``, ``1.5e-7``)."""
    s = d.cast("string")
    parts = F.split(s, "E")
    mantissa, exp = F.element_at(parts, 1), F.element_at(parts, 2).cast("int")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(mantissa, "^-", ""), r"\.0$", ""), r"\.", "")
    padded = F.rpad(digits, F.greatest(F.length(digits), exp + 1), "0")
    rest = F.substr(padded, exp + 2)
    plain = F.concat(sign, F.substr(padded, F.lit(1), exp + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    tiny = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    tail = F.substr(digits, F.lit(2))
    science = F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""),
                       F.lit("e"), exp.cast("string"))
    return (F.when(~s.contains("E"), s).when(exp.between(7, 15), plain).when(exp.between(-5, -1), tiny)
            .otherwise(science))


def raw_field(payload_text: Column, key: str) -> Column:
    """Text of a top-level field as written (a string without its quotes); NULL if absent or no object."""
    name = "`" + key.replace("`", "``") + "`"
    return F.from_json(payload_text, f"struct<{name}: string>")[key]


def scalar_as_string(payload_text: Column, key: str) -> Column:
    """A top-level string / number / bool as text, a float as the reference prints it; null, array, object and
    absent → NULL."""
    v = json_field(payload_text, key)
    kind = F.schema_of_variant(v)
    raw = raw_field(payload_text, key)
    number = F.when(raw.rlike("[.eE]"), float_text(raw.cast("double"))).otherwise(raw)
    return (F.when(kind.rlike("^(OBJECT|ARRAY|VOID|NULL)"), F.lit(None).cast("string"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", raw).otherwise(number))
