"""Fitted code tables, metadata segments and pixmaps against brute force and round trips."""

import hashlib
import heapq
import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import huffman as H
from tessera.sources import metadata as M


def least_cost(counts):
    """Bits of an optimal prefix code of unlimited length, and the least depth of such a code's tree."""
    heap, cost = [(n, 0) for n in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, deep), (b, deeper) = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, (a + b, max(deep, deeper) + 1))
    return cost, heap[0][1]


def test_limited_lengths_equal_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        counts = {s: rng.choice([0, 1, 2, 5, 30, 200]) for s in range(rng.randrange(2, 8))}
        every = itertools.product(range(1, 4), repeat=len(counts))
        best = min(sum(n * x for n, x in zip(counts.values(), v, strict=True)) for v in every if sum(2.0**-x for x in v) <= 1)
        lengths = H.code_lengths(counts, 3)
        assert max(lengths.values()) <= 3 and sum(counts[s] * n for s, n in lengths.items()) == best


def test_fitted_codes_are_optimal_prefix_free_and_bounded():
    rng = random.Random(4)
    tables = [{7: 3}, {1: 1, 2: 1}, {k: 1 for k in range(256)}, {k: 3**k for k in range(30)}]
    tables += [{s: rng.randrange(1, 10 ** rng.randrange(1, 6)) for s in rng.sample(range(256), rng.randrange(2, 200))} for _ in range(40)]
    for counts in tables:
        codes = H.canonical_codes(counts)
        assert {s for s, _, _ in codes} == set(counts) and max(n for _, n, _ in codes) <= 16
        texts = sorted(f"{c:0{n}b}" for _, n, c in codes)
        assert not any(b.startswith(a) for a, b in itertools.pairwise(texts)) and not any(set(t) == {"1"} for t in texts)
        cost = sum(n * counts[s] for s, n, _ in codes)
        best, depth = least_cost([*counts.values(), 0])
        assert cost == best if depth <= 16 else cost > best


def test_fitted_codes_of_images(spark):
    rows = [(i, 0, "ac", s, (s * 7 + i) % 11) for i in range(3) for s in range(20)]
    out = H.fitted_codes(spark.createDataFrame(rows, "image_id int, qidx int, cls string, sym int, n long")).collect()
    assert len(out) == sum(1 for r in rows if r[4] > 0)
    assert H.fitted_codes(spark.createDataFrame([], "image_id int, qidx int, cls string, sym int, n long")).count() == 0


def test_exif_and_xmp_are_read_back(spark):
    rows = [(1, b"one"), (2, b""), (3, None), (4, b"x" * 65528)]
    made = spark.createDataFrame(rows, "image_id int, d binary").select("image_id", M.exif_segment(F.col("d")).alias("e"), F.unhex(M.xmp_text(F.col("d"))).alias("x"))
    assert [(r["image_id"], r["e"] is None, r["x"] is None) for r in made.orderBy("image_id").collect()] == [(1, False, False), (2, False, False), (3, True, True), (4, True, True)]
    files = made.where("e IS NOT NULL").select("image_id", F.concat(F.unhex(F.lit("FFD8")), "x", "e", "e", F.unhex(F.lit("FFD9"))).alias("jpeg"))
    out = M.metadata_of(files).collect()
    assert {r["image_id"]: (bytes(r["exif"]), bytes(r["xmp"]), r["extended"], r["others"]) for r in out} == {1: (b"one", b"one", None, None), 2: (b"", b"", None, None)}


def test_long_packets_are_split_and_put_together(spark):
    tag = b'<x xmpNote:HasExtendedXMP="' + b"0" * 32 + b'"/>'
    packets = {1: tag + b"y" * 70_000, 2: tag + b"z" * (65_503 - len(tag) + M.XMP_PART), 3: b"y" * 70_000, 4: b" " * 65_500 + tag + b"y" * 9_000, 5: tag[:-3] + b"?" + b"y" * 70_000, 6: tag + b"e" * 200_000}
    made = spark.createDataFrame(list(packets.items()), "image_id int, d binary").select("image_id", F.unhex(M.xmp_text(F.col("d"))).alias("x"))
    segments = {r["image_id"]: r["x"] for r in made.collect()}
    assert {k for k, x in segments.items() if x is None} == {3, 4, 5}
    for k in (1, 2, 6):
        jpeg = b"\xff\xd8" + bytes(segments[k]) + b"\xff\xd9"
        _, main, rest, _, _ = M.metadata_in(jpeg)
        assert len(main) == 65_503 and rest == packets[k][65_503:] and main == packets[k][:65_503].replace(b"0" * 32, hashlib.md5(rest).hexdigest().upper().encode(), 1)
    assert len(M.walked(b"\xff\xd8" + bytes(segments[2]) + b"\xff\xd9")) == 3  # an exact multiple ends with an empty part


def test_extended_xmp_needs_every_part(spark):
    body = bytes(range(250)) * 20
    parts = [bytes(r["segment"]) for r in M.extended_xmp_parts(spark.createDataFrame([(1, body)], "image_id int, xmp binary"), most=900).orderBy("at").collect()]
    assert M.XMP_PART == 65458 and len(parts) == 6 and hashlib.md5(body).hexdigest().upper().encode() in parts[0]
    wrong = [*parts[:-1], parts[-1][:-1] + b"?"]
    files = [(1, parts[::-1]), (2, parts[:-1]), (3, [*parts, parts[0]]), (4, wrong)]
    images = spark.createDataFrame([(k, b"\xff\xd8" + b"".join(p) + b"\xff\xd9") for k, p in files], "image_id int, jpeg binary")
    out = {r["image_id"]: r["extended"] for r in M.metadata_of(images).collect()}
    assert bytes(out[1]) == body and [out[k] for k in (2, 3, 4)] == [None] * 3


def test_text_profiles_and_pixmaps_reject_what_is_broken(spark):
    texts = ["\nexif\n       2\n0a0B", "\nexif\n       3\n0a0b", "\nexif\n99999999999\n00", "x", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.text_profile(F.col("t"))).collect()]
    assert bytes(got[0]) == b"\n\x0b" and got[1:] == [None] * 5
    images = [(1, b"P6 2 1\n255\n" + b"\n#\x00\xff\x01\x02"), (2, b"P6 2 1\n255\nabc"), (3, b"P6 1 1 65535\nabcdef"), (4, None), (5, b"P5 1 1 255 abc"), (6, b"P6\n#c\n 1#d\n1 9\nabc")]
    out = sorted(map(tuple, M.pixmap_pixels(spark.createDataFrame(images, "image_id int, content binary")).collect()))
    assert out == [(1, 0, 0, 10, 35, 0), (1, 0, 1, 255, 1, 2), (6, 0, 0, 97, 98, 99)]


def test_long_comments_in_pixmaps(spark):
    images = [(1, b"P6\n#" + b"c" * 5000 + b"\n" + b"# more\n" * 3000 + b"1 1\n255\nabc")]
    assert M.pixmap_pixels(spark.createDataFrame(images, "image_id int, content binary")).count() == 1


def test_packets_name_their_extension(spark):
    packet = b'<x xmpNote:HasExtendedXMP="' + b"0" * 32 + b'"/>\xff'
    rows = spark.createDataFrame([(packet, b"data"), (b"<x/>", b"data")], "p binary, d binary").select(M.with_digest(F.col("p"), F.col("d"))).collect()
    assert bytes(rows[0][0]) == packet.replace(b"0" * 32, hashlib.md5(b"data").hexdigest().upper().encode()) and bytes(rows[1][0]) == b"<x/>"


def test_compressed_and_broken_chunks(spark):
    import zlib

    def file(*chunks):
        return b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + bytes(4) for k, d in chunks)

    text = b"\nexif\n       2\n0a0b"
    files = [
        file((b"zTXt", b"Raw profile type exif\0\0" + zlib.compress(text)), (b"iCCP", b"name\0\0" + zlib.compress(b"profile"))),
        file((b"iTXt", b"XML:com.adobe.xmp\0\1\0en\0key\0" + zlib.compress(b"xmp")), (b"tEXt", b"Raw profile type xmp\0" + text)),
        file((b"iCCP", b"name\0\0broken"), (b"tEXt", b"Raw profile type exif\0\nexif\n 9\n00"), (b"IEND", b""), (b"iCCP", b"n\0\0" + zlib.compress(b"late"))),
        file((b"tEXt", b"XML:com.adobe.xmp\0x"))[:-9],
        b"",
        None,
    ]
    out = {r["image_id"]: tuple(None if x is None else bytes(x) for x in r[1:]) for r in M.png_metadata(spark.createDataFrame(list(enumerate(files)), "image_id int, content binary")).collect()}
    assert out == {0: (b"\n\x0b", None, b"profile"), 1: (None, b"xmp", None), **{k: (None,) * 3 for k in range(2, 6)}}


def test_copies_of_few_files_are_held_at_a_time():
    """a batch's 10,000 files were all held in copies."""
    import pyarrow as pa

    from tessera.sources import metadata as M

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["k"])
    cut = list(M.few([batch, batch.slice(0, 3), batch.slice(0, 0)]))
    assert max(x.num_rows for x in cut) <= M.FEW and [r["k"] for x in cut for r in x.to_pylist()] == [*range(1000), 0, 1, 2]
