"""Column expressions of image coding: colours, transforms, quantisers, symbols.

Integers are widened before they are multiplied; shifts are arithmetic. Every expression
of a null is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def bit_length(x: Column) -> Column:
    """Bits that a non-negative integer needs; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Y - 128 of 8-bit RGB, 16-bit fixed point."""
    return F.shiftright(19595 * r + 38469 * g + 7471 * b + 32768 - 128 * 65536, 16)


def chroma_u(r: Column, g: Column, b: Column, shift: int = 16) -> Column:
    """U of RGB, or of the sum of four pixels with shift 18."""
    return F.shiftright(-11059 * r - 21709 * g + 32768 * b + (1 << (shift - 1)), shift)


def chroma_v(r: Column, g: Column, b: Column, shift: int = 16) -> Column:
    return F.shiftright(32768 * r - 27439 * g - 5329 * b + (1 << (shift - 1)), shift)


def quality_scale(quality: Column) -> Column:
    """Percentage by which a quality of 0..100 scales the base matrices."""
    scale = F.when(quality <= 0, 5000.0).when(quality < 50, 5000.0 / quality).when(quality < 100, 2.0 * (100 - quality)).otherwise(0.0)
    return F.floor(scale).cast("int")


def scaled(m: Column, scale: Column) -> Column:
    """A matrix entry at a scale, within 1..255."""
    return clamp(F.floor((m * scale + 50) / 100).cast("int"), 1, 255)


def least_quant(m: Column, tolerance: int) -> Column:
    """The smallest entry allowed under a tolerance in 256ths, at least 1."""
    return F.greatest(F.lit(1), F.shiftright(m * (256 - tolerance), 8))


def reduced(m: Column, reduction: float) -> Column:
    """An entry for a size reduction in percent (1 at least)."""
    return clamp(F.floor(m * 100.0 / max(1.0, reduction) + 0.5).cast("int"), 1, 255)


def reciprocal(q: Column) -> Column:
    return F.when(q == 1, 65535).otherwise(F.floor((65536 + F.floor(q / 2)) / q).cast("int"))


def rounding(q: Column, pos: Column, bias: int = 120) -> Column:
    """Added to an absolute coefficient (x16) before it is divided by q."""
    share = F.when((q == 1) | (pos == 0), 128).otherwise(bias)
    return F.shiftright(F.shiftleft(share * q, 4) + 128, 8)


def threshold(q: Column, pos: Column, bias: int = 120) -> Column:
    """The least absolute coefficient (x16) that doesn't become zero."""
    return F.floor(((1 << 20) + reciprocal(q) - 1) / reciprocal(q)).cast("int") - rounding(q, pos, bias)


def quantized(v: Column, q: Column, pos: Column, bias: int = 120) -> Column:
    """The quantised value of a coefficient (x16), by the reciprocal of q."""
    size = F.shiftright(F.shiftright(((F.abs(v) + rounding(q, pos, bias)).cast("long")) * reciprocal(q), 16), 4).cast("int")
    return F.when(v < 0, -size).otherwise(size)


def squared_error(v: Column, q: Column, level: Column) -> Column:
    """Error of one coefficient after quantisation, in sample units."""
    off = (F.shiftright(F.abs(v), 4) - q * F.abs(level)).cast("long")
    return off * off


def psnr(error: Column, samples: Column) -> Column:
    """dB for a sum of squared errors over 8-bit samples; 99 without any error."""
    return F.when(error > 0, F.lit(4.3429448) * F.log(samples * F.lit(65025.0) / error)).otherwise(99.0)


def suffix(value: Column) -> Column:
    """The bits that follow a size symbol: the value, or for negatives its one's complement."""
    n = bit_length(F.abs(value))
    return F.when(value >= 0, value).otherwise((value - 1).bitwiseAND(F.pow(F.lit(2), n).cast("int") - 1))


def dct_columns(s: list) -> list:
    """One 8-point column pass (scaled by 8) of the integer forward transform, over numpy integers."""
    high = lambda a, c: (a * c) >> 16
    a, d = [s[i] + s[7 - i] for i in range(4)], [s[i] - s[7 - i] for i in range(4)]
    p, q = (a[0] - a[3]) << 3, (a[1] - a[2]) << 3
    f1, f2 = high((d[1] - d[2]) << 4, 23170), high((d[1] + d[2]) << 4, 23170)
    d0, d3 = d[0] << 3, d[3] << 3
    h3, h1, h0, h2 = d3 - f1, d3 + f1, d0 - f2, d0 + f2
    g = high(h3, -21746) + h3 + 1
    total, other = a[0] + a[3], a[1] + a[2]
    return [(total + other) << 3, high(h1, 13036) + h2 + 1, high(q, 27146) + p, h0 - g, (total - other) << 3, h3 + high(h0, -21746) + h0, high(p, 27146) - q, high(h2, 13036) - h1]


#: The four sets of row-pass cosine weights C1..C7, for rows (0, 4), (1, 7), (2, 6), (3, 5).
ROW_WEIGHTS = {
    0: (22725, 21407, 19266, 16384, 12873, 8867, 4520),
    1: (31521, 29692, 26722, 22725, 17855, 12299, 6270),
    2: (29692, 27969, 25172, 21407, 16819, 11585, 5906),
    3: (26722, 25172, 22654, 19266, 15137, 10426, 5315),
}
ROW_SET = (0, 1, 2, 3, 0, 3, 2, 1)


def row_matrix(row: int) -> list[list[int]]:
    """Weights of one row pass: 8 outputs over 8 inputs, by the symmetries of the cosine."""
    c = (0, *ROW_WEIGHTS[ROW_SET[row]])

    def weight(k: int, x: int) -> int:
        if k == 0:
            return c[4]
        at = (2 * x + 1) * k % 32  # angle in 16ths of a half turn
        sign = 1
        if at > 16:
            at = 32 - at
        if at > 8:
            at, sign = 16 - at, -1
        return 0 if at == 8 else sign * c[at]

    return [[weight(k, x) for x in range(8)] for k in range(8)]
