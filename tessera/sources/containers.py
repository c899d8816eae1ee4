"""Image containers: sniffing, baseline headers written and read, embedded profiles.

Files are a BINARY column. Headers are written as hexadecimal text until the last step, as
Spark concatenates text in generated code, and read file by file in Arrow batches, as their
segments follow each other. What can't be read, or doesn't fit, is null, never an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import expressions as X
from tessera.functions.tables import BASE_QUANT, STD_HUFFMAN, zigzag_order
from tessera.operators import packing


#: Blocks on a side of 65,535 samples, the most that a frame header states.
MOST_BLOCKS = 65535 // 8


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def kind(content: Column) -> Column:
    """JPG, PNG, PPM or ??? by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("FFD8FF"), "JPG").when(head == "89504E47", "PNG").when(head.startswith("5036"), "PPM").otherwise("???")


def be(value: Column, octets: int) -> Column:
    """A non-negative integer as big-endian hexadecimal text; null if it doesn't fit."""
    return F.when(F.length(F.hex(value)) <= 2 * octets, F.lpad(F.hex(value), 2 * octets, "0"))


def code_segments(codes: DataFrame) -> DataFrame:
    """(image_id, dht): DHT segments of an image's own tables (cls, qidx, sym, len, code), luma DC and AC first, hexadecimal."""
    lengths = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda n: F.lpad(F.hex(F.size(F.filter("t", lambda x: x["len"] == n))), 2, "0"))
    ordered = F.sort_array(F.collect_list(F.struct("len", "code", "sym"))).alias("t")
    tables = codes.groupBy("image_id", "qidx", "cls").agg(ordered)
    body = F.concat(F.when(F.col("cls") == "dc", "0").otherwise("1"), F.col("qidx").cast("string"), F.array_join(lengths, ""), F.array_join(F.transform("t", lambda x: F.lpad(F.hex(x["sym"]), 2, "0")), ""))
    each = tables.select("image_id", F.struct("qidx", (F.col("cls") != "dc").alias("ac"), F.concat(F.lit("FFC4"), be(F.length(body) / 2 + 2, 2), body).alias("h")).alias("x"))
    return each.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), "").alias("dht"))


def standard_segments(components: int) -> str:
    """DHT segments of the standard tables, hexadecimal."""
    out = ""
    for which in range(1 if components == 1 else 2):
        for cls, high in (("dc", 0), ("ac", 1)):
            counts, symbols = STD_HUFFMAN[cls, which]
            body = f"{high}{which}" + "".join(f"{n:02x}" for n in counts) + symbols.replace(" ", "")
            out += f"ffc4{len(body) // 2 + 2:04x}{body}"
    return out.upper()


def matrix_segment(matrices: dict[int, list[int]]) -> str:
    """One DQT segment of 8-bit matrices, hexadecimal."""
    body = "".join(f"{k:02x}" + "".join(f"{m[p]:02x}" for p in zigzag_order()) for k, m in sorted(matrices.items()))
    return f"ffdb{len(body) // 2 + 2:04x}{body}".upper()


def frame_text(mode: str) -> tuple[str, str]:
    """What stands in a mode's SOF behind the sides, and its SOS segment, hexadecimal."""
    components = 1 if mode == "400" else 3
    parts = "".join(f"{c + 1:02X}{'22' if mode == '420' and c == 0 else '11'}{min(c, 1):02X}" for c in range(components))
    scan = f"FFDA{6 + 2 * components:04X}{components:02X}" + "".join(f"{c + 1:02X}{min(c, 1) * 17:02X}" for c in range(components)) + "003F00"
    return f"{components:02X}{parts}", scan


def framed(rows: DataFrame, mode: str, dqt: Column, dht: Column) -> Column:
    """A whole file of a row (width, height, scan; app: raw marker segments, if there); null where a side is over 65,535."""
    parts, scan = frame_text(mode)
    frame = F.concat(F.lit("FFC0000B08" if mode == "400" else "FFC0001108"), be(F.col("height"), 2), be(F.col("width"), 2), F.lit(parts))
    app = F.coalesce("app", F.unhex(F.lit(""))) if "app" in rows.columns else F.unhex(F.lit(""))
    start = F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000"))
    return F.concat(start, app, F.unhex(F.concat(dqt, frame, dht, F.lit(scan))), F.col("scan"), F.unhex(F.lit("FFD9")))


def baseline_files(scans: DataFrame, matrices: dict[int, list[int]], mode: str, dht: DataFrame | None = None) -> DataFrame:
    """(image_id, jpeg) of scans (image_id, width, height, scan; app: raw marker segments, if there).

    Null where a side is over 65,535. dht (image_id, dht): images' own code tables; standard ones by default.
    """
    components = 1 if mode == "400" else 3
    rows = scans.withColumn("dht", F.lit(standard_segments(components))) if dht is None else scans.join(dht, "image_id")
    dqt = matrix_segment({k: m for k, m in matrices.items() if k < components})
    return rows.select("image_id", framed(rows, mode, F.lit(dqt), F.col("dht")).alias("jpeg"))


def files_of(scans: DataFrame, mode: str = "mode", quality: str = "q") -> DataFrame:
    """scans (image_id, width, height, scan, …) with jpeg, each in its own mode and at its own quality, with standard code tables."""
    base = lambda k: F.array(*[F.lit(BASE_QUANT[k][p]) for p in zigzag_order()])
    table = lambda k: F.concat(F.lit(f"{k:02X}"), F.array_join(F.transform(base(k), lambda m: F.lpad(F.hex(X.scaled(m, X.quality_scale(F.col(quality)))), 2, "0")), ""))
    made = {m: framed(scans, m, F.concat(F.lit("FFDB0043" if m == "400" else "FFDB0084"), table(0), *([] if m == "400" else [table(1)])), F.lit(standard_segments(1 if m == "400" else 3))) for m in ("400", "420", "444")}
    jpeg = F.when(F.col(mode) == "400", made["400"]).when(F.col(mode) == "420", made["420"]).when(F.col(mode) == "444", made["444"])
    return scans.withColumn("jpeg", F.when(F.col(quality).isNotNull(), jpeg))


def header_bytes(components: int, code_symbols: Column, app: Column, exif: Column, iccp: Column, xmp: Column) -> Column:
    """Size of all but the scan, from the sizes of metadata (0: none) and the number of symbols in all code tables.

    It is the estimate that a search for a target size uses: extended XMP counts 40 bytes a part.
    """
    tables = 1 if components == 1 else 2
    size = 20 + app + F.when(exif > 0, exif + 8).otherwise(0)
    size = size + F.when(iccp > 0, F.floor((iccp - 1) / 65519 + 1) * 18 + iccp).otherwise(0)
    size = size + F.when(xmp > 0, xmp + 33 + F.when(xmp > 65533, (F.floor(xmp / 65458) + 1) * 40).otherwise(0)).otherwise(0)
    return (size + tables * 65 + 4 + 10 + 3 * components + 8 + 2 * components + 2 + 2 * tables * 21 + code_symbols).cast("long")


def gray_files(blocks: DataFrame, matrices: dict[int, list[int]], most: int = MOST_BLOCKS, codes: DataFrame | None = None) -> DataFrame:
    """(image_id, jpeg): baseline files of coded one-component blocks that stand in one column, in scan order.

    Where that would be over `most` blocks high, rows are as many blocks wide as it takes,
    and the last row is filled with flat blocks of the last level; null if the width doesn't fit either.
    """
    sizes = blocks.groupBy("image_id").agg(F.count("*").alias("n"), F.max(F.struct("scan_idx", "dc")).alias("last"))
    sizes = sizes.withColumn("across", F.ceil(F.col("n") / most)).withColumn("down", F.ceil(F.col("n") / F.col("across")))
    spare = sizes.withColumn("spare", F.col("across") * F.col("down") - F.col("n")).where("spare > 0")
    if not spare.isEmpty():
        names = ["image_id", "comp", "qidx", "scan_idx", "dc", "ac"]
        at = F.explode(F.sequence(F.col("last.scan_idx") + 1, F.col("last.scan_idx") + F.col("spare"))).alias("scan_idx")
        blocks = blocks.select(*names).unionByName(spare.select("image_id", F.lit(0).alias("comp"), F.lit(0).alias("qidx"), at, F.col("last.dc").alias("dc"), F.array(F.lit(0)).alias("ac")))
    sides = sizes.select("image_id", (F.col("across") * 8).alias("width"), (F.col("down") * 8).alias("height"))
    dht = None if codes is None else code_segments(codes)
    return baseline_files(packing.scans(blocks, codes).join(sides, "image_id"), matrices, "400", dht)


def walked(raw: bytes) -> list[tuple[int, int, bytes]]:
    """(place from 1, marker, payload) of the marker segments of a file up to the scan; [] if it isn't one.

    Bytes before the first marker are skipped; the walk ends at what isn't a whole segment.
    """
    if raw[:2] != b"\xff\xd8":
        return []
    out, at = [], raw.find(b"\xff", 2)
    while 0 < at and at + 4 <= len(raw):
        marker, length = int.from_bytes(raw[at : at + 2], "big"), int.from_bytes(raw[at + 2 : at + 4], "big")
        if not 0xFF01 <= marker < 0xFFFF or length < 2 or at + 2 + length > len(raw):
            break
        out.append((at + 1, marker, raw[at + 4 : at + 2 + length]))
        if marker == 0xFFDA:
            break
        at += 2 + length
    return out


def segments(images: DataFrame, content: str = "jpeg", key: str = "image_id") -> DataFrame:
    """(key, at, marker, payload as hexadecimal text) of the marker segments up to the scan, however many; files in Arrow batches."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = walked(batch.column(1)[k].as_py() or b"")
                if found:
                    own = batch.column(0).take(pa.array(np.full(len(found), k)))
                    yield pa.RecordBatch.from_arrays([own, pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2].hex().upper() for x in found])], names=[key, "at", "marker", "payload"])

    return images.select(key, content).mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, at int, marker int, payload string")


def matrices_in(found: list[tuple[int, int, bytes]]) -> dict[int, list[int] | None] | None:
    """Number -> steps in natural order of all quantisation tables (None beyond the second); None if one is broken.

    16-bit steps are clamped to 255, zero steps to 1; of tables of one number the last counts.
    """
    out, order = {}, zigzag_order()
    for _, marker, payload in found:
        at = 0
        while marker == 0xFFDB and at < len(payload):
            wide, number = payload[at] >> 4, payload[at] & 15
            values = payload[at + 1 : at + 65 + 64 * wide]
            if wide > 1 or number > 3 or len(values) < 64 + 64 * wide:
                return None
            steps = np.frombuffer(values, ">u2" if wide else "u1")
            matrix = np.zeros(64, int)
            matrix[order] = np.clip(steps, 1, 255)
            out[number] = matrix.tolist() if number < 2 else None
            at += 65 + 64 * wide
    return out


FACTS = "width int, height int, components int, is_420 boolean, dqt int, luma array<int>, chroma array<int>"


def facts_in(found: list[tuple[int, int, bytes]]) -> tuple:
    """width, height, components and is_420 of the first SOF0 or SOF1; number of matrices, the first two of them."""
    frame = next((p for _, marker, p in found if marker in (0xFFC0, 0xFFC1) and len(p) >= 6), None)
    sides = (None,) * 4
    if frame:
        whole = len(frame) >= 6 + 3 * frame[5]
        is_420 = frame[5] == 3 and [frame[7 + 3 * c] for c in range(3)] == [0x22, 0x11, 0x11] if whole else None
        sides = (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big"), frame[5], is_420)
    tables = matrices_in(found) or {}
    return (*sides, len(tables), tables.get(0), tables.get(1))


def inspected(images: DataFrame, content: str = "jpeg") -> DataFrame:
    """images with width, height, components, is_420, dqt (number of matrices), luma and chroma (their steps), all from headers."""
    names = [*images.columns, *(x.split()[0] for x in FACTS.split(", "))]
    kinds = [pa.int32()] * 3 + [pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            rows = [facts_in(walked(x or b"")) for x in batch.column(0).to_pylist()]
            more = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=names)

    schema = StructType([*images.schema, *StructType.fromDDL(FACTS)])
    return images.select(F.col(content).alias("_raw"), *images.columns).mapInArrow(run, schema)


def profile_in(found: list[tuple[int, int, bytes]]) -> bytes | None:
    """A colour profile put together from its numbered APP2 parts; None unless all parts are there once."""
    parts = sorted(p[12:] for _, marker, p in found if marker == 0xFFE2 and p.startswith(b"ICC_PROFILE\0") and len(p) >= 14)
    if not parts or [p[0] for p in parts] != list(range(1, len(parts) + 1)) or max(p[1] for p in parts) != len(parts):
        return None
    return b"".join(p[2:] for p in parts)


def profile_text(profile: Column, most: Column | int = 65519) -> Column:
    """APP2 segments that carry a profile in numbered parts of `most` bytes, as hexadecimal text; null if they are over 255."""
    most = most if isinstance(most, Column) else F.lit(most)
    n = F.ceil(F.octet_length(profile) / most).cast("int")

    def part(k: Column) -> Column:
        data = F.substr(profile, (k - 1) * most + 1, most)
        return F.concat(F.lit("FFE2"), be(F.octet_length(data) + 16, 2), F.lit("4943435F50524F46494C4500"), be(k, 1), be(n, 1), F.hex(data))

    whole = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(255)))), part), "")
    return F.when(n > 255, None).when(n > 0, whole).otherwise("")
