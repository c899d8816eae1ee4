"""Metadata of image files: EXIF and XMP segments, extended XMP, text profiles; and plain pixmaps.

Written by column functions, a file's segments in one projection; read byte by byte, in one walk
of each file, in Arrow batches. What can't be read, or doesn't fit a segment, is null, never an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.containers import be, profile_in, walked

#: Signatures at the start of APP1 payloads, and the bytes a segment's length field can count.
EXIF = b"Exif\x00\x00"
XMP = b"http://ns.adobe.com/xap/1.0/\x00"
EXTENDED_XMP = b"http://ns.adobe.com/xmp/extension/\x00"
LONGEST = 65535
#: Bytes of data in a part of extended XMP: less the length field, the signature, 32 of digest, two 32-bit numbers.
XMP_PART = LONGEST - 2 - len(EXTENDED_XMP) - 40


def app1(signature: bytes, data: Column) -> Column:
    """An APP1 segment; null if it would be too long."""
    size = F.octet_length(data) + len(signature) + 2
    return F.when(size <= LONGEST, F.concat(F.unhex(F.concat(F.lit("FFE1"), be(size, 2), F.lit(signature.hex().upper()))), data))


def exif_segment(data: Column) -> Column:
    return app1(EXIF, data)


def xmp_segment(data: Column) -> Column:
    return app1(XMP, data)


def extended_xmp_parts(packets: DataFrame, data: str = "xmp", key: str = "image_id", most: int = XMP_PART) -> DataFrame:
    """(key, guid, at, segment): APP1 segments that carry data too long for one; guid is its upper-case MD5."""
    total = F.octet_length(data)
    rows = packets.where(total > 0).select(key, data, F.upper(F.md5(data)).alias("guid"), total.alias("total"), F.explode(F.sequence(F.lit(0), total - 1, F.lit(most))).alias("at"))
    part = F.substr(F.col(data), F.col("at") + 1, F.lit(most))
    size = F.octet_length(part) + 2 + len(EXTENDED_XMP) + 40
    head = F.concat(F.lit("FFE1"), be(size, 2), F.lit(EXTENDED_XMP.hex().upper()), F.hex(F.encode("guid", "UTF-8")), be(F.col("total"), 4), be(F.col("at"), 4))
    return rows.select(key, "guid", "at", F.concat(F.unhex(head), part).alias("segment"))


def profile_text(name: str, data: Column) -> Column:
    """A profile as text: a blank line, its name, its length, and lines of 72 hexadecimal digits."""
    digits = F.regexp_replace(F.lower(F.hex(data)), "(.{72})(?=.)", "$1\n")
    return F.concat(F.lit(f"\n{name}\n"), F.lpad(F.octet_length(data).cast("string"), 8, " "), F.lit("\n"), digits)


def text_profile(text: Column) -> Column:
    """The bytes of a profile written as text; null unless its length is the one stated."""
    field = lambda k: F.regexp_extract(text, r"^\n[^\n]*\n *([0-9]{1,9})\n([0-9a-fA-F\s]*)$", k)
    digits = F.regexp_replace(field(2), r"\s", "")
    return F.when(F.length(digits) == 2 * field(1).try_cast("int"), F.unhex(digits))


#: A binary pixmap's header: blanks and comments of any length between its numbers, one blank before the samples.
PIXMAP = re.compile(rb"P6" + rb"(?:\s|#[^\n]*\n)+([0-9]{1,9})" * 3 + rb"\s")


def pixmap_header(raw: bytes | None) -> tuple[int, int, int, int] | None:
    """(width, height, most, where samples begin) of a binary pixmap of 8-bit samples; None if it is none, or isn't whole."""
    found = PIXMAP.match(raw or b"")
    if not found:
        return None
    width, height, most = map(int, found.groups())
    whole = width and height and 0 < most < 256 and found.end() + 3 * width * height <= len(raw)
    return (width, height, most, found.end()) if whole else None


def pixmaps(images: DataFrame, content: str = "content", key: str = "image_id") -> DataFrame:
    """(key, width, height, content) of the images that are binary pixmaps: their sides and packed RGB samples."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                if head := pixmap_header(raw):
                    width, height, _, at = head
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([raw[at : at + 3 * width * height]], pa.binary())], names=[key, "width", "height", "content"])

    return images.select(key, content).mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, width int, height int, content binary")


def pixmap_pixels(images: DataFrame, content: str = "content", key: str = "image_id", band: int = 1 << 16) -> DataFrame:
    """(key, y, x, r, g, b) of the images that are binary pixmaps, in Arrow batches of `band` pixels."""
    names = [key, "y", "x", "r", "g", "b"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                if not (head := pixmap_header(raw)):
                    continue
                width, height, _, at = head
                rgb = np.frombuffer(raw, np.uint8, 3 * width * height, at).reshape(-1, 3)
                for low in range(0, len(rgb), band):
                    some = rgb[low : low + band].astype(np.int32)
                    y, x = np.divmod(np.arange(low, low + len(some)), width)
                    own = pa.array(np.full(len(some), k))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(y), pa.array(x), *(pa.array(some[:, c]) for c in range(3))], names=names)

    return images.select(key, content).mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, y long, x long, r int, g int, b int")


#: Files of which copies are held at a time.
FEW = 64


def few(batches):
    """Batches cut into such of FEW rows: what is read of files is copies of them."""
    for batch in batches:
        for low in range(0, batch.num_rows, FEW):
            yield batch.slice(low, FEW)


#: Keys of text chunks that carry metadata, whether as a text profile, and what it is.
PNG_KEYS = {
    b"Raw profile type exif": (True, "exif"),
    b"Raw profile type xmp": (True, "xmp"),
    b"Raw profile type APP1": (True, "exif"),
    b"XML:com.adobe.xmp": (False, "xmp"),
}


def raw_profile(text: bytes) -> bytes | None:
    """The bytes of a text profile; None unless its length is the one stated."""
    parts = re.fullmatch(rb"\n[^\n]*\n *([0-9]{1,9})\n([0-9a-fA-F\s]*)", text)
    digits = re.sub(rb"\s", b"", parts[2]) if parts else b""
    return bytes.fromhex(digits.decode()) if parts and len(digits) == 2 * int(parts[1]) else None


def png_chunks(raw: bytes):
    """(type, data) of the chunks of a file up to the end chunk, or what isn't a whole chunk."""
    at = 8 if raw[:8] == b"\x89PNG\r\n\x1a\n" else len(raw)
    while at + 12 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if at + 12 + size > len(raw) or kind == b"IEND":
            return
        yield kind, raw[at + 8 : at + 8 + size]
        at += 12 + size


def inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def chunk_text(kind: bytes, data: bytes) -> tuple[bytes, bytes | None]:
    """(key, text) of a tEXt, zTXt or iTXt chunk."""
    key, _, rest = data.partition(b"\0")
    if kind == b"tEXt":
        return key, rest
    if kind == b"zTXt":
        return key, inflated(rest[1:])
    body = rest[2:].split(b"\0", 2)
    text = body[2] if len(body) == 3 else None
    return key, inflated(text) if text is not None and rest[:1] == b"\1" else text


def png_metadata(images: DataFrame, content: str = "content", key: str = "image_id") -> DataFrame:
    """(key, exif, xmp, iccp) out of the text and colour-profile chunks of PNG files; of several, the first that is sound."""

    def found_in(raw: bytes | None) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for kind, data in png_chunks(raw or b""):
            if kind in (b"tEXt", b"zTXt", b"iTXt"):
                name, text = chunk_text(kind, data)
                as_profile, what = PNG_KEYS.get(name, (False, None))
                value = raw_profile(text) if as_profile and text is not None else text
            elif kind == b"iCCP":
                what, value = "iccp", inflated(data.partition(b"\0")[2][1:])
            else:
                continue
            if what and value:
                found.setdefault(what, value)
        return found

    def run(batches):
        for batch in few(batches):
            rows = [found_in(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(c) for r in rows], pa.binary()) for c in ("exif", "xmp", "iccp"))], names=[key, "exif", "xmp", "iccp"])

    return images.select(key, content).mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, exif binary, xmp binary, iccp binary")


#: Fixed value: what stands before the digest of extended XMP in the main packet.
HAS_EXTENDED = 'xmpNote:HasExtendedXMP="'


def with_digest(packet: Column, extended: Column) -> Column:
    """packet with the digest of extended data written where it names one; as it is where it names none."""
    at = F.locate(HAS_EXTENDED, F.decode(packet, "ISO-8859-1"))
    return F.when(at > 0, F.overlay(packet, F.encode(F.upper(F.md5(extended)), "UTF-8"), at + len(HAS_EXTENDED))).otherwise(packet)


#: Fixed value: bytes of a packet that stay in the main segment where it doesn't fit one.
XMP_MAIN = 65503


def app1_text(signature: bytes, data: Column) -> Column:
    """An APP1 segment as hexadecimal text; null if it would be too long."""
    return F.concat(F.lit("FFE1"), be(F.octet_length(data) + len(signature) + 2, 2), F.lit(signature.hex().upper()), F.hex(data))


def xmp_text(packet: Column, split: int = XMP_MAIN) -> Column:
    """XMP as hexadecimal segments: one, or a main one of `split` bytes that names the digest of the rest, and extended ones; null where it names none."""
    latin = F.decode(packet, "ISO-8859-1")
    at = F.locate(HAS_EXTENDED, latin)
    main, rest = F.substr(packet, F.lit(1), F.lit(split)), F.substr(packet, F.lit(split + 1))
    sound = (at > 0) & (at - 1 + len(HAS_EXTENDED) + 33 <= split) & (F.substr(latin, at + len(HAS_EXTENDED) + 32, F.lit(1)) == '"')
    guid, total = F.hex(F.encode(F.upper(F.md5(rest)), "UTF-8")), F.octet_length(rest)

    def part(k: Column) -> Column:
        data = F.substr(rest, k * XMP_PART + 1, F.lit(XMP_PART))
        return F.concat(F.lit("FFE1"), be(F.octet_length(data) + 2 + len(EXTENDED_XMP) + 40, 2), F.lit(EXTENDED_XMP.hex().upper()), guid, be(total, 4), be(k * XMP_PART, 4), F.hex(data))

    parts = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(total / XMP_PART).cast("int")), part), "")
    fits = F.octet_length(packet) + len(XMP) + 2 <= LONGEST
    return F.when(fits, app1_text(XMP, packet)).when(sound, F.concat(app1_text(XMP, with_digest(main, rest)), parts))


def extension_in(found: list[tuple[int, int, bytes]]) -> bytes | None:
    """Extended XMP put together; None unless the parts share one digest and total, meet without gap or overlap, and match the digest."""
    size = len(EXTENDED_XMP)
    parts = [p[size:] for _, marker, p in found if marker == 0xFFE1 and p.startswith(EXTENDED_XMP) and len(p) >= size + 40]
    data, heads = b"", {p[:36] for p in parts}
    for p in sorted(parts, key=lambda p: (p[36:40], len(p))):
        if int.from_bytes(p[36:40], "big") != len(data):
            return None
        data += p[40:]
    if len(heads) != 1:
        return None
    head = heads.pop()
    return data if int.from_bytes(head[32:], "big") == len(data) and head[:32] == hashlib.md5(data).hexdigest().upper().encode() else None


METADATA = ("exif", "xmp", "extended", "iccp", "others")


def metadata_in(raw: bytes | None) -> tuple:
    """METADATA of a file, in one walk."""
    return metadata_among(walked(raw or b""))


def metadata_among(found: list[tuple[int, int, bytes]]) -> tuple:
    """The first EXIF and XMP, extended XMP, the colour profile, and the other APP1 and APP2 segments as they are."""
    app1 = [p for _, marker, p in found if marker == 0xFFE1]
    first = [next((p[len(mark) :] for p in app1 if p.startswith(mark)), None) for mark in (EXIF, XMP)]
    known = {0xFFE1: (EXIF, XMP, EXTENDED_XMP), 0xFFE2: (b"ICC_PROFILE\0",)}
    others = b"".join(marker.to_bytes(2, "big") + (len(p) + 2).to_bytes(2, "big") + p for _, marker, p in found if marker in known and not p.startswith(known[marker]))
    return (*first, extension_in(found), profile_in(found), others or None)


def metadata_of(images: DataFrame, content: str = "jpeg", key: str = "image_id") -> DataFrame:
    """(key, exif, xmp, extended, iccp, others) of all files; null where a file has none, or not a whole one."""

    def run(batches):
        for batch in few(batches):
            rows = [metadata_in(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(len(METADATA)))], names=[key, *METADATA])

    return images.select(key, content).mapInArrow(run, f"`{key}` {dict(images.dtypes)[key]}, " + ", ".join(f"{c} binary" for c in METADATA))
