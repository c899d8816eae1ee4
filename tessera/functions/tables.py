"""Constant tables of baseline image coding (ITU-T T.81) as plain values and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def zigzag_order(side: int = 8) -> list[int]:
    """Natural position at each zigzag place: anti-diagonals, walked up and down in turn."""
    out = []
    for d in range(2 * side - 1):
        cells = [(y, d - y) for y in range(side) if 0 <= d - y < side]
        out += [y * side + x for y, x in (cells if d % 2 else cells[::-1])]
    return out


#: T.81 Annex K.1, luminance (0) and chrominance (1) quantisation, natural order.
BASE_QUANT = {
    0: [
        16, 11, 10, 16, 24, 40, 51, 61,
        12, 12, 14, 19, 26, 58, 60, 55,
        14, 13, 16, 24, 40, 57, 69, 56,
        14, 17, 22, 29, 51, 87, 80, 62,
        18, 22, 37, 56, 68, 109, 103, 77,
        24, 35, 55, 64, 81, 104, 113, 92,
        49, 64, 78, 87, 103, 121, 120, 101,
        72, 92, 95, 98, 112, 100, 103, 99,
    ],
    1: [
        17, 18, 24, 47, 99, 99, 99, 99,
        18, 21, 26, 66, 99, 99, 99, 99,
        24, 26, 56, 99, 99, 99, 99, 99,
        47, 66, 99, 99, 99, 99, 99, 99,
        99, 99, 99, 99, 99, 99, 99, 99,
        99, 99, 99, 99, 99, 99, 99, 99,
        99, 99, 99, 99, 99, 99, 99, 99,
        99, 99, 99, 99, 99, 99, 99, 99,
    ],
}

#: T.81 Annex K.3, numbers of codes of each length 1..16 and symbols in code order.
STD_HUFFMAN = {
    ("dc", 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    ("dc", 1): ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    ("ac", 0): (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a "
        "25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a "
        "83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca "
        "d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    ("ac", 1): (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a "
        "26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a "
        "82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca "
        "d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}

#: Component layout of each chroma mode: (component, block in the unit, quantiser).
LAYOUT = {
    "420": [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 4, 1), (2, 5, 1)],
    "444": [(0, 0, 0), (1, 1, 1), (2, 2, 1)],
    "400": [(0, 0, 0)],
}


def standard_codes() -> list[tuple[str, int, int, int, int]]:
    """(class, quantiser, symbol, length, code) of the standard tables: canonical codes in order of length."""
    out = []
    for (kind, which), (counts, symbols) in STD_HUFFMAN.items():
        code, todo = 0, [int(x, 16) for x in symbols.split()]
        for length, n in enumerate(counts, 1):
            for symbol in todo[:n]:
                out.append((kind, which, symbol, length, code))
                code += 1
            todo, code = todo[n:], code << 1
    return out


def zigzag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(pos, zz) for zz, pos in enumerate(zigzag_order())], "pos int, zz int")


def base_quant(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, pos, m) for k, values in BASE_QUANT.items() for pos, m in enumerate(values)], "qidx int, pos int, m int")


def huffman(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(standard_codes(), "cls string, qidx int, sym int, len int, code int")


def sql_values(rows: list[tuple], names: str) -> str:
    """A table of constants for SQL text."""
    lines = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {lines}) AS t({names}))"
