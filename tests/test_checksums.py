"""Checksums by chunks against whole ones."""

import random
import zlib

from pyspark.sql import functions as F

from tessera.operators import checksums as K


def test_chunks_give_the_checksum_of_the_whole(spark):
    rng = random.Random(1)
    rows = [(k, rng.randbytes(n)) for k, n in enumerate([0, 1, 6, 7, 8, 99, 1000, 70_001])] + [(50, None)]
    df = spark.createDataFrame(rows, "doc_id int, content binary")
    want = {k: (zlib.crc32(x), len(x)) for k, x in rows if x is not None}
    for size in (7, 1000, 1 << 20):
        assert {r["doc_id"]: (r["crc"], r["n"]) for r in K.crc32(df, size=size).collect()} == want


def test_chunks_come_in_any_order_and_from_earlier_runs(spark):
    whole = bytes(range(256)) * 300
    chunks = [(1, at, min(1000, len(whole) - at), len(whole), zlib.crc32(whole[at : at + 1000])) for at in range(0, len(whole), 1000)]
    random.Random(2).shuffle(chunks)
    out = K.combined(spark.createDataFrame(chunks, "k int, at long, n long, total long, crc long").repartition(5), "k").first()
    assert (out["crc"], out["n"]) == (zlib.crc32(whole), len(whole))
    a, b = zlib.crc32(b"earlier"), zlib.crc32(whole)
    made = spark.range(1).select(K.resumed(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(len(whole)))).first()[0]
    assert made == zlib.crc32(b"earlier" + whole)
