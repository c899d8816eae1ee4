"""The file sink, the header source and the folder job."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import containers, files
from tessera.sources import metadata as M
from tessera.streaming import folder


def jpeg(payload: bytes = b"", width: int = 24) -> bytes:
    dqt = b"\xff\xdb\x00\x43\x00" + bytes(range(1, 65))
    sof = b"\xff\xc0\x00\x0b\x08" + (16).to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + payload + dqt + sof + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + bytes(100_000) + b"\xff\xd9"


def everything(path) -> dict:
    return {x.name: x.read_bytes() for x in path.rglob("*") if x.is_file()}


def test_committed_files_are_whole_and_nothing_else_stays(spark, tmp_path):
    files.register(spark)
    rows = [(f"{k}.bin", bytes([k]) * k) for k in range(20)] + [("none", None)]
    spark.createDataFrame(rows, "name string, content binary").repartition(5).write.format("tessera_files").mode("append").save(f"file://{tmp_path}/out")
    assert everything(tmp_path / "out") == {k: v for k, v in rows if v is not None}
    assert all(x.name.startswith("part-") for x in (tmp_path / "out").iterdir())


@pytest.mark.parametrize("why", ["null names", "two of a name", "a failing task"])
def test_failed_jobs_leave_nothing(spark, tmp_path, why):
    files.register(spark)
    rows = spark.range(40).repartition(4).select(F.concat("id", F.lit(".bin")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    bad = {
        "null names": rows.withColumn("name", F.when(F.col("name") != "7.bin", F.col("name"))),
        "two of a name": rows.withColumn("name", F.lit("same")),
        "a failing task": rows.withColumn("content", F.when(F.col("name") == "39.bin", F.encode(F.raise_error(F.lit("stop")).cast("string"), "UTF-8")).otherwise(F.col("content"))),
    }[why]
    with pytest.raises(Exception):
        bad.write.format("tessera_files").mode("append").save(f"file://{tmp_path}/out")
    assert everything(tmp_path) == {}


def test_tasks_that_outlive_their_job_leave_nothing(tmp_path):
    import pyarrow as pa

    batches = [pa.record_batch({"name": [name], "content": [b"x"]}) for name in ("a", "b")]
    for end in ("abort", "commit"):
        writer = files.FileWriter(f"file://{tmp_path}/{end}")
        kept = writer.write(iter([pa.record_batch({"name": ["kept"], "content": [b"y"]})]))

        def late():
            yield batches[0]
            getattr(writer, end)([kept])  # noqa: B023
            yield batches[1]

        for task in (late(), iter(batches)):
            with pytest.raises(OSError):
                writer.write(task)
        assert everything(tmp_path / end) == ({"kept": b"y"} if end == "commit" else {})


def test_no_files_are_written_and_read(spark, tmp_path):
    files.register(spark)
    spark.createDataFrame([("none", None)], "name string, content binary").write.format("tessera_files").mode("append").save(f"file://{tmp_path}/out")
    assert spark.read.format("tessera_headers").load(f"file://{tmp_path}/out").collect() == []


def test_headers_are_read_by_ranges(spark, tmp_path):
    files.register(spark)
    exif = b"\xff\xe1" + (2 + 6 + 60_000).to_bytes(2, "big") + b"Exif\0\0" + bytes(60_000)
    rows = [("a.jpg", jpeg()), ("b.jpg", jpeg(exif, 32)), ("c.jpg", b"\xff\xd8\xff"), ("d.txt", b"no image"), ("e.jpg", b""), ("f.jpg", jpeg()[:90]), ("g.jpg", b"\xff\xd8" + b"x" * 200 + jpeg()[2:])]
    spark.createDataFrame(rows, "name string, content binary").write.format("tessera_files").mode("append").save(f"file://{tmp_path}/out")
    out = {r["name"]: r for r in spark.read.format("tessera_headers").option("filesPerPartition", "2").load(f"file://{tmp_path}/out").collect()}
    whole = {r["name"]: r for r in containers.inspected(spark.createDataFrame(rows, "name string, content binary"), "content").collect()}
    facts = ("width", "height", "components", "is_420", "dqt", "luma", "chroma")
    assert set(out) == {k for k, _ in rows}
    for name, content in rows:
        assert out[name]["n_bytes"] == len(content) and [out[name][c] for c in facts] == [whole[name][c] for c in facts]
        assert out[name]["bytes_read"] < 600
    more = {r["name"]: r for r in spark.read.format("tessera_headers").option("metadata", "true").load(f"file://{tmp_path}/out").collect()}
    assert bytes(more["b.jpg"]["exif"]) == bytes(60_000) and more["a.jpg"]["exif"] is None and 60_000 < more["b.jpg"]["bytes_read"] < 61_000


def test_planning_holds_folders_and_not_files(tmp_path):
    import pickle
    import tracemalloc

    def planned(folder, n):
        for sub, files_there in ((folder / "part-a", n), (folder / "part-b" / "more", 3), (folder / "part-c", 0), (folder / f"{files.STAGING}x" / "part-d", 5)):
            sub.mkdir(parents=True)
            for k in range(files_there):
                (sub / f"{sub.name}-{k}.jpg").touch()
        reader = files.HeaderReader({"path": f"file://{folder}/", "filesPerPartition": "50"})
        tracemalloc.start()
        partitions = reader.partitions()
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        read = [[x[1] for x in reader.read(p)] for p in partitions]
        assert sorted(y for x in read for y in x) == sorted([f"part-a-{k}.jpg" for k in range(n)] + [f"more-{k}.jpg" for k in range(3)])
        assert max(map(len, read)) < 4 * max(50, n / files.SHARES)
        return held + sum(len(pickle.dumps(p)) for p in partitions)

    planned(tmp_path / "first", 60)
    few, many = planned(tmp_path / "few", 1600), planned(tmp_path / "many", 6400)
    assert many < 1.5 * few < 64_000


def test_a_folder_is_handled_file_by_file_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    pixels = lambda w, h, f: f"P6 {w} {h} 255\n".encode() + bytes(x for k in range(w * h) for x in f(k))
    (source / "gray.ppm").write_bytes(pixels(20, 18, lambda k: [k % 251] * 3))
    (source / "noise.ppm").write_bytes(pixels(33, 17, lambda k: [k * 97 % 256, k * 31 % 256, k * 171 % 256]))
    (source / "with.jpg").write_bytes(jpeg(b"\xff\xe1\x00\x0bExif\0\0abc"))
    folder.run(spark, f"file://{source}", f"file://{out}", folder.Options(quality=60))
    (source / "late.ppm").write_bytes(pixels(16, 16, lambda k: [k % 256, 0, 0]))
    for _ in range(2):  # the last run finds nothing new
        folder.run(spark, f"file://{source}", f"file://{out}", folder.Options(size=500, mode="420", passes=4))
    made = everything(out / "images")
    assert sorted(made) == ["gray-0.jpg", "late-1.jpg", "noise-0.jpg"]
    seen = {k: containers.facts_in(containers.walked(x)) for k, x in made.items()}
    assert seen["gray-0.jpg"][:3] == (20, 18, 1) and seen["noise-0.jpg"][:4] == (33, 17, 3, False) and seen["late-1.jpg"][:4] == (16, 16, 3, True)
    report = spark.read.parquet(f"{out}/report").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["kind"], r["batch"]) for r in report) == [("gray.ppm", "PPM", 0), ("late.ppm", "PPM", 1), ("noise.ppm", "PPM", 0), ("with.jpg", "JPG", 0)]
    own = next(r for r in report if r["kind"] == "JPG")
    assert (own["width"], own["n_exif"], own["crc_exif"], own["n_xmp"]) == (24, 3, 891568578, None)


def test_matrices_are_printed_in_rows(spark):
    out = folder.printed(spark.createDataFrame([("a", list(range(64)))], "k string, m array<int>"), ["k"]).orderBy("y").collect()
    assert [[r[f"x{k}"] for k in range(8)] for r in out] == [list(range(8 * y, 8 * y + 8)) for y in range(8)]


def test_each_image_has_its_own_mode_and_quality(spark):
    rows = [(k, m, q, 8, 8, b"scan") for k, (m, q) in enumerate([("400", 10.0), ("420", 62.5), ("444", 100.0), ("what", 50.0), ("420", None)])]
    out = {r["image_id"]: r["jpeg"] for r in containers.files_of(spark.createDataFrame(rows, "image_id int, mode string, q double, width int, height int, scan binary")).collect()}
    assert out[3] is None and out[4] is None
    for k, q in ((0, 10.0), (1, 62.5), (2, 100.0)):
        scale = int(5000 / q if q < 50 else 2 * (100 - q))
        luma = [max(1, min(255, (m * scale + 50) // 100)) for m in containers_base()]
        assert containers.facts_in(containers.walked(bytes(out[k])))[5] == luma and M.metadata_in(bytes(out[k]))[0] is None


def containers_base() -> list[int]:
    from tessera.functions.tables import BASE_QUANT

    return BASE_QUANT[0]
