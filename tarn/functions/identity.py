"""Stable identities: content hashes, fingerprints, keys and name-based UUIDs, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprint(*values: Column) -> Column:
    """SHA-256 of the values as text, joined by U+001F; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def json_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as a JSON object with sorted keys, nulls written out."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def stable_key(kind: Column, record: Column, version: Column, chunk: Column) -> Column:
    return F.concat_ws(":", kind, record.cast("string"), F.coalesce(version.cast("string"), F.lit("-")), chunk.cast("string"))


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def unit_id(key: Column) -> Column:
    return uuid5(F.concat(F.lit("tarn-unit:"), key))
