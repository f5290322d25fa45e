"""Bucket functions for sharding (KV-4, SRC-2).

* :func:`xx_bucket` — ``pmod(xxhash64(key), n)``: the default; stable across
  runs and engines' partition counts, one JVM call per row.
* :func:`adler32_bucket` — ``adler32(utf8(key)) % n`` computed from built-in
  array functions, for shard-by-shard parity with files laid out by adler32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADLER_MOD = 65521  # fixed value: the adler32 modulus (largest prime < 2**16)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf8_bytes(col) -> Column:
    """``array<int>`` of the UTF-8 bytes of a string."""
    h = F.hex(F.encode(_c(col), "UTF-8"))
    n = F.length(h) / 2
    idx = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("int"))


def adler32(col) -> Column:
    """zlib.adler32 of the UTF-8 bytes, as a long."""
    init = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc, v):
        a = (acc["a"] + v) % ADLER_MOD
        return F.struct(a.alias("a"), ((acc["b"] + a) % ADLER_MOD).alias("b"))

    st = F.aggregate(utf8_bytes(col), init, step)
    return st["b"] * 65536 + st["a"]


def adler32_bucket(col, n: int) -> Column:
    return (adler32(col) % n).cast("long")


def xx_bucket(col, n: int) -> Column:
    return F.pmod(F.xxhash64(_c(col)), F.lit(n)).cast("long")
