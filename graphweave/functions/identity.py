"""Content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest16(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by ``|``; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def node_id(kind: Column, key: Column, project: str = "1", discriminator: str = "") -> Column:
    return digest16(F.lit(project), kind, key, F.lit(discriminator))
