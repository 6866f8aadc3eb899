"""Identities, content hashes and deterministic samples. All are SHA-256 over UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_id(repo: Column, kind: Column, identity: Column) -> Column:
    """The hash of repo, kind and identity with zero characters between."""
    return F.sha2(F.concat(repo, F.lit("\0"), kind, F.lit("\0"), identity), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept; maps are sorted too."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(**fields: Column) -> Column:
    """Changes when and only when a record's content does; leave out what moves by itself, as the commit."""
    return F.sha2(canonical_json(**fields), 256)


def body_fingerprint(body: Column) -> Column:
    return F.sha2(body, 256)


def sample_key(tag: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{tag}|"), key.cast("string")), 256)


def sample(rows: DataFrame, tag: str, key: str, n: int) -> DataFrame:
    """The n rows whose key hashes lowest under tag: the same ones every time."""
    return rows.orderBy(sample_key(tag, F.col(key)), key).limit(n)
