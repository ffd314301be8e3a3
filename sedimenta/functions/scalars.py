"""Small column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2 become 0, 1, 2, 3 (two's complement of 64 bits)."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(u: Column) -> Column:
    """Bits of a 64-bit pattern read as unsigned; 0 for 0."""
    return F.when(u == 0, 0).otherwise(F.length(F.bin(u)))


def varint_size(u: Column) -> Column:
    """Bytes of the LEB128 form of a 64-bit pattern."""
    return F.greatest(F.lit(1), F.ceil(bit_width(u) / F.lit(7.0))).cast("int")


def leading_zeros(u: Column) -> Column:
    return (F.lit(64) - bit_width(u)).cast("int")


def pack_width(span: Column) -> Column:
    """Bytes that hold 0..span: 1, 2, 4 or 8."""
    return F.when(span < 256, 1).when(span < 65536, 2).when(span < 4294967296, 4).otherwise(8)


def wrap64(d: Column) -> Column:
    """A decimal modulo 2**64 as a signed long: the wrapping arithmetic that ANSI mode refuses."""
    two64, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    m = F.pmod(d.cast("decimal(38,0)"), two64)
    return F.when(m >= half, m - two64).otherwise(m).cast("long")


def wrapping_sub(a: Column, b: Column) -> Column:
    """a - b of longs; only overflowing rows take the decimal way."""
    return F.coalesce(F.try_subtract(a, b), wrap64(a.cast("decimal(38,0)") - b.cast("decimal(38,0)")))


CLOUD = r"^(s3|gs|az|file)://([^/]*)/?(.*)$"


def cloud_url(url: Column) -> Column:
    """scheme, bucket and key of a storage address; null where it is none."""
    part = lambda i: F.regexp_extract(url, CLOUD, i)
    return F.when(url.rlike(CLOUD), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def strict_int(s: Column) -> Column:
    """A long only where the whole text is a signed number: unlike try_cast, no spaces."""
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("long"))


def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def round_double(x: Column, places: int) -> Column:
    """A double rounded in binary, as SQL engines of doubles do: x * 10^places to the nearest integer, halves away from zero, and back.
    F.round() rounds the shortest decimal text instead, so 323 / 640 (0.5046875) becomes 0.504688 there and 0.504687 here."""
    scaled = F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(x)
