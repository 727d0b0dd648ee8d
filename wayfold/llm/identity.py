"""Digests that tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(doc: str, text: str) -> Column:
    """16 bytes that id and text decide: however many texts there are, no two different ones share it. Null differs from empty."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc), part(text))))
