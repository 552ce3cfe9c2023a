"""HMAC-SHA256 as native Spark expressions.

HMAC(k, m) = H((k' ^ opad) || H((k' ^ ipad) || m)), with k' the key padded to
the 64-byte block (hashed first when longer). The two padded keys are 64-byte
literals computed on the driver from the configured secret, so the per-row work
is two ``sha2`` calls inside whole-stage codegen – no Python UDF.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def _bin_lit(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def hmac_sha256_hex(message: Column, secret: str, binary: bool = False) -> Column:
    """Lower-case hex HMAC-SHA256 of ``message`` (a string as UTF-8 bytes, or binary)."""
    ipad, opad = pads(secret)
    msg = message if binary else F.encode(message, "UTF-8")
    inner = F.unhex(F.sha2(F.concat(_bin_lit(ipad), msg), 256))
    return F.sha2(F.concat(_bin_lit(opad), inner), 256)


def hmac_sql(message_sql: str, secret: str) -> str:
    """The same construction as SQL text (used by the DuckDB oracles)."""
    ipad, opad = pads(secret)
    return (f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({message_sql}))))")


def signature_ok(body: Column, header_value: Column, secret: str) -> Column:
    """Header trimmed, optional ``sha256=`` prefix, compared to lower-case hex."""
    v = F.trim(header_value)
    expected = F.when(v.startswith("sha256="), F.substr(v, F.lit(8))).otherwise(v)
    return header_value.isNotNull() & (expected == hmac_sha256_hex(body, secret))
