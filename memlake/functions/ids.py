"""Stable identifiers: the same input always gives the same id, so reruns overwrite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the RFC 4122 name space for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 UUID of a name in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *parts)))


def unit_draw(key: Column) -> Column:
    """Number in (0, 1) fixed by the key, for weighted sampling."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
