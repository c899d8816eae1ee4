"""Token ids as length-delimited binary records, with a separate offset index.

A shard is a file of records in ascending order of document id (null ids first; rows of one
id by a hash of the text, so that no id has to fit one shard), shards are numbered in the
same order:

    u64 payload length | u32 masked CRC-32 of the length | payload | u32 masked CRC-32 of the payload

all little-endian; masked means rotated right by 15 bits plus 0xA282EAD8, so that a
checksum isn't itself checksummed. A payload is u8 has-id flag, i64 document id, u8 bytes
in an id (2 if the vocabulary fits 16 bits, else 4), u32 number of ids, the ids. Beside
`name.rec` stands `name.idx` of fixed-size entries (u64 offset, u64 length, i64 id), for
reading records in any order with two seeks.

Each task writes its shard under a name of its own and reports it as a manifest row; only
rows of tasks that Spark committed reach the manifest, so retries and lost executors leave
no wrong file in it. Files go through pyarrow's file systems to the shared folder.

Ids are those that the tokenizers library gives for the whole text (a special token's string
is that token, or ordinary text with `plain`), and end_id; a null text is the end id alone;
repeated rows are records of their own; an empty table makes no shard; only the id and the
text are read, so no column clashes. Where the tokenizer file has nothing but the byte-level
pre-tokenizer with its usual pattern, no pre-token crosses from a non-space to a following
space: texts are then encoded in pieces that begin at single spaces, each distinct piece
once per worker while a memory of `MEMORY` bytes holds it; texts with other runs of white
space beside a space, and all texts of any other tokenizer, are encoded in one go.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import run_dir, stored, table

#: Bytes of pieces that a worker remembers (with `OVERHEAD` for each), and the longest piece it does.
END_ID, MEMORY, OVERHEAD, REMEMBERED = 0, 320 << 20, 240, 64
HEAD, PAYLOAD, ENTRY = "<QI", "<BqBI", "<QQq"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return length + masked_crc(length).to_bytes(4, "little") + payload + masked_crc(payload).to_bytes(4, "little")


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(PAYLOAD, doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width, n = struct.unpack_from(PAYLOAD, payload)
    return doc_id if has else None, np.frombuffer(payload, f"<u{width}", n, struct.calcsize(PAYLOAD))


def unframed(read, offset: int = 0) -> bytes | None:
    """The next record's payload, checked; None at the end. read(n) gives up to n bytes."""
    head = read(struct.calcsize(HEAD))
    if not head:
        return None
    length, crc = struct.unpack(HEAD, head)
    if masked_crc(head[:8]) != crc:
        raise ValueError(f"bad length checksum near byte {offset}")
    payload = read(length)
    if len(payload) != length or masked_crc(payload) != int.from_bytes(read(4), "little"):
        raise ValueError(f"bad payload checksum near byte {offset}")
    return payload


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its place, through the index."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at[: -len(".rec")] + ".idx") as index:
        index.seek(number * struct.calcsize(ENTRY))
        offset, length, _ = struct.unpack(ENTRY, index.read(struct.calcsize(ENTRY)))
    with fs.open_input_file(at) as records:
        records.seek(offset)
        return parsed(unframed(lambda n: records.read(n)))


class Encoder:
    """A tokenizer file's ids of whole texts, with a bounded memory of pieces."""

    own: dict[tuple[str, bool], Encoder] = {}
    #: A space beside other white space: there a piece may not begin.
    odd = re.compile(r" \s|\s | $")

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        #: Byte-level vocabularies write each byte as one character.
        self.sizes = np.array([len(x) for x, _ in names])
        self.memory: dict[str, bytes] = {}
        self.held = 0
        made = json.loads(self.tokenizer.to_str())
        before, special = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        self.cuttable = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not made.get("normalizer")
            and [i for _, i in names] == list(range(len(names)))
            and not any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in special)
        )

    @classmethod
    def at(cls, path: str, plain: bool = False) -> Encoder:
        if (path, plain) not in cls.own:
            cls.own[path, plain] = cls(path, plain)
        return cls.own[path, plain]

    def batch(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that all begin with a space: encoded as one text, cut where the tokens' bytes fill a piece."""
        if not pieces:
            return []
        ids = np.array(self.tokenizer.encode("".join(pieces), add_special_tokens=False).ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in pieces])) + 1
        raw, width = ids.astype(f"<u{self.width}").tobytes(), self.width
        return [raw[a * width : b * width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        whole, split, missing, memory = [], [], {}, self.memory
        if self.held > MEMORY:
            memory.clear()
            self.held = 0
        for k, text in enumerate(texts):
            if not self.cuttable or self.odd.search(text):
                whole.append(k)
            else:
                first, *rest = text.split(" ")
                split.append((k, pieces := [first, *[" " + x for x in rest]]))
                missing.update((x, None) for x in pieces if x not in memory)
        new, first = [x for x in missing if x[:1] == " "], [x for x in missing if x[:1] != " "]
        long = {}
        for some, raws in ((new, self.spaced(new)), (first, self.batch(first))):
            for x, raw in zip(some, raws, strict=True):
                if len(x) <= REMEMBERED:
                    memory[x] = raw
                    self.held += len(x) + len(raw) + OVERHEAD
                else:
                    long[x] = raw
        for k, pieces in split:
            out[k] = b"".join([memory[x] if x in memory else long[x] for x in pieces]) if long else b"".join([memory[x] for x in pieces])
        for k, ids in zip(whole, self.batch([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shards: int | None = None, plain: bool = False) -> DataFrame:
    """Writes (doc_id, text) as shards to folder; the manifest: shard, path, records, ids.

    shards: by default as many as docs has partitions, whatever adaptive execution would merge.
    """

    def run(batches):
        encoder, shard, records, ids, at = Encoder.at(tokenizer, plain), TaskContext.get().partitionId(), 0, 0, 0
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        first = next(batches, None)
        if first is None:
            return
        base = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, path = pafs.FileSystem.from_uri(base)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path + ".rec") as out, fs.open_output_stream(path + ".idx") as index:
            batch = first
            while batch is not None:
                keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
                for k in range(0, len(texts), 256):
                    for key, own in zip(keys[k : k + 256], encoder.encode(texts[k : k + 256]), strict=True):
                        own += end
                        n = len(own) // encoder.width
                        frame = framed(struct.pack(PAYLOAD, key is not None, key or 0, encoder.width, n) + own)
                        out.write(frame)
                        index.write(struct.pack(ENTRY, at, len(frame), key or 0))
                        records, ids, at = records + 1, ids + n, at + len(frame)
                batch = next(batches, None)
        if records:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [base + ".rec"], "records": [records], "ids": [ids]})

    rows = docs.select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shards or max(1, rows.rdd.getNumPartitions()), *order)
    ordered = dealt.sortWithinPartitions(*order, "text")
    return stored(ordered.mapInArrow(run, "shard long, path string, records long, ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(shard, number, doc_id, start in the shard, n_tokens, ids_crc32) of all records, checked as they are read."""

    def run(batches):
        for batch in batches:
            for shard, path in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    number = start = 0
                    rows = []
                    while (payload := unframed(lambda n: f.read(n))) is not None:
                        doc_id, ids = parsed(payload)
                        rows.append((shard, number, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        number, start = number + 1, start + len(ids)
                        if len(rows) == 8192:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    def made(rows):
        names = ["shard", "number", "doc_id", "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    spread = manifest.select("shard", "path").repartitionByRange(max(1, manifest.count()), "shard")  # a task for each shard
    return spread.mapInArrow(run, "shard long, number long, doc_id long, start long, n_tokens long, ids_crc32 long")


def indexed(manifest: DataFrame) -> DataFrame:
    """read(), with start counted over all shards before. Offsets: one row for each shard, at most as many as write() had tasks."""
    before = F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")
    offsets = manifest.select("shard", before.alias("before"))
    rows = read(manifest).join(F.broadcast(offsets), "shard")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{run_dir(spark)}/records-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return indexed(manifest)


QUERIES = {"op9_binary_records": op9}
