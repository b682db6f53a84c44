"""Reproducible randomness: md5 of the row's own key, never of its position.

The value does not depend on partitioning, task retries or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """md5 of the parts joined by ``|`` (Columns are read, the rest is literal)."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def bits32(hex_digest: Column) -> Column:
    """First 32 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """Uniform double in [0, 1) fixed by the parts."""
    return bits32(digest(*parts)) / F.lit(4294967296.0)
