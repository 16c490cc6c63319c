"""Content hashes, perceptual hashes and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column, kind: str = "md5") -> Column:
    """md5, sha256, or the first 12 hex digits of sha1 (kind `short`)."""
    return {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "short": lambda c: F.substring(F.sha1(c), 1, 12)}[kind](content)


def difference_hash(values: Column, bits: int = 63) -> Column:
    """Bit i, most significant first, is set where element i + 1 is greater than element i."""
    rises = F.zip_with(F.slice(values, 1, bits), F.slice(values, 2, bits), lambda a, b: F.when(b > a, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(rises, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def stable_key(batch: Column, path: Column, size: Column, mtime: Column, prefix: str = "sim-") -> Column:
    """prefix and 32 hex digits of a sha256 of the parts."""
    parts = F.concat_ws("|", batch, path, size.cast("string"), mtime.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(parts, 256), 1, 32))


def rolling_hash36(text: Column) -> Column:
    """Base-31 rolling hash modulo 2^32 in base 36; characters of the basic plane."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))
    number = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.lower(F.conv(number.cast("string"), 10, 36))


def batch_row_key(batch: Column, index: Column, text: Column) -> Column:
    """batch, 1-based index of at least three digits, rolling hash."""
    number = index.cast("string")
    return F.concat_ws("-", batch, F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), rolling_hash36(text))
