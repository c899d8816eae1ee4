"""CRC-32 of contents of any size: chunks are checksummed by many tasks and put together by a plain sum.

CRCs are linear over GF(2): appending n bytes multiplies a CRC by x^(8n) modulo the polynomial,
and the CRC of a whole is the exclusive or of its chunks' CRCs, each multiplied for the bytes
behind it. So the aggregate is a bit_xor, in any order, combined before the shuffle, and a CRC
that was computed earlier is one chunk more (`resumed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the polynomial, its highest power left out, lowest bit first.
POLYNOMIAL = 0xEDB88320
ONE = 1 << 31


def product(a: int, b: int) -> int:
    """Of two polynomials, modulo the polynomial."""
    out = 0
    for k in range(31, -1, -1):
        out ^= b if a >> k & 1 else 0
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def powers(count: int = 40) -> list[int]:
    """x^(8 * 2^k) for k from 0."""
    out = [ONE >> 8]
    while len(out) < count:
        out.append(product(out[-1], out[-1]))
    return out


def times(a: Column, b: Column) -> Column:
    """product() of two columns of longs."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), b.alias("b"))

    def step(state: Column, k: Column) -> Column:
        bit = F.expr("1L").bitwiseAND(F.call_function("shiftright", a, k))
        odd = state["b"].bitwiseAND(1)
        return F.struct(state["sum"].bitwiseXOR(state["b"] * bit).alias("sum"), F.shiftright(state["b"], 1).bitwiseXOR(odd * POLYNOMIAL).alias("b"))

    return F.aggregate(F.sequence(F.lit(31), F.lit(0)), start, step, lambda s: s["sum"])


def appended(crc: Column, n: Column) -> Column:
    """A CRC's share in that of a whole, n bytes further on."""
    table = F.array(*[F.lit(x).cast("long") for x in powers()])
    some = F.filter(F.sequence(F.lit(0), F.lit(39)), lambda k: F.call_function("shiftright", n.cast("long"), k).bitwiseAND(1) == 1)
    return F.aggregate(some, crc, lambda c, k: times(c, table[k]))


def chunk_crcs(contents: DataFrame, content: str, key: str, size: int) -> DataFrame:
    """(key, at, n, total, crc) of the chunks of `size` bytes; an empty content is one chunk."""
    total = F.octet_length(content)
    rows = contents.where(F.col(content).isNotNull()).select(key, content, total.cast("long").alias("total"), F.explode(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size))).alias("at"))
    part = F.substr(F.col(content), F.col("at") + 1, F.lit(size))
    return rows.select(key, F.col("at").cast("long").alias("at"), F.octet_length(part).cast("long").alias("n"), "total", F.crc32(part).alias("crc"))


def combined(chunks: DataFrame, key: str) -> DataFrame:
    """(key, crc, n) of wholes from chunks (key, at, n, total, crc)."""
    behind = F.col("total") - F.col("at") - F.col("n")
    return chunks.groupBy(key).agg(F.bit_xor(appended(F.col("crc"), behind)).alias("crc"), F.sum("n").alias("n"))


def resumed(before: Column, crc: Column, n: Column) -> Column:
    """The CRC of what `before` is the CRC of and n more bytes whose own CRC is crc."""
    return appended(before, n).bitwiseXOR(crc)


def crc32(contents: DataFrame, content: str = "content", key: str = "doc_id", size: int = 1 << 20) -> DataFrame:
    """(key, crc, n) of contents, by chunks of `size` bytes."""
    return combined(chunk_crcs(contents, content, key, size), key)
