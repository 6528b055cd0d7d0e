"""Deterministic ids and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of name-based UUIDs (RFC 9562).
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """Name-based UUID (version 5), equal to the standard one for any UTF-8 name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lpad(variant, 2, "0"), F.substring(h, 19, 2)), F.substring(h, 21, 12))


def hashed_share(key: Column) -> Column:
    """A stable value in [0, 1) of a key: the first six hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long") % 1000 / F.lit(1000.0)
