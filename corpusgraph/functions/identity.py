"""Stable keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_id(path: Column) -> Column:
    return F.sha1(path)


def mail_id(subject: Column, sender: Column, date: Column, body: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (subject, sender, date, F.substring(body, 1, 256))]
    return F.concat(F.lit("hash-"), F.sha2(F.concat_ws("|", *parts), 256))


def set_key(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 12)


def query_key(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def boundary_key(text: Column, version: str, model: str, least: int, most: int) -> Column:
    """Key of a text's cached boundaries: the settings and the text's digest."""
    return F.concat(F.lit(f"{version}:{model}:{least}:{most}:"), F.sha2(text, 256))


def summary_key(text: Column, model: str, longest: int, temperature: float) -> Column:
    """Key of a document's cached summary."""
    return F.concat(F.lit(f"doc-summary-v1:{model}:{longest}:{temperature}:"), F.sha2(text, 256))


def profile_hash(*fields: str) -> Column:
    """Digest of a profile's fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def rollback_token(kind: str, key: Column, at: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string"), F.lit(f":{at}")), 256)
