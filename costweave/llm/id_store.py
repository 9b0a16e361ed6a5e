"""Token ids in shard files with a minimal perfect hash index over document keys.

A shard file holds, little-endian:

    magic | ids (2 or 4 bytes each) | key of each record (8) | first id of each record, and the end (8)
    | bits of the hash levels | fingerprint of each slot (4) | record of each slot (4) | footer

The footer has the counts, the bits of each level and the sections' places, so a reader needs the
end of the file, then a few fixed-size reads per key. Records lie in ascending order of keys; a
repeated key's records follow each other, and its slot points to the first of them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from costweave.llm.shared import slices
from costweave.llm.tokens import encoder

MAGIC = b"CWIDS\x00\x01\n"
#: Bits for each key of a level, and levels; keys that collide in all of them are listed.
SPREAD, LEVELS = 2, 24


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits for each key: two rounds of multiply and shift."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys, in about three bits a key.

    A level is a bit array; a key that has its place to itself sets it, keys that meet go on
    to the next level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: list[int]) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]
        self.n = int(self.before[-1]) + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, levels = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            size = -(-SPREAD * len(left) // 64) * 64
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(flat, bitorder="little").view("<u8")
        return cls(sizes, bits, sorted(left.tolist()))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; any slot, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            under = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            todo, base = todo[~hit], base + size
        for i in todo.tolist():
            if int(keys[i]) in self.rest:
                out[i] = int(self.before[-1]) + self.rest.index(int(keys[i]))
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


def shard_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """The file of these records, which are in ascending order of keys, nulls first."""
    nulls = sum(k is None for k in keys)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    firsts = np.r_[0, np.cumsum([len(x) for x in ids])].astype("<i8")
    distinct, record = np.unique(key[nulls:], return_index=True)
    index = PerfectHash.of(distinct)
    slots = index.slot(distinct)
    marks, records = np.zeros(index.n, "<u4"), np.zeros(index.n, "<u4")
    marks[slots], records[slots] = fingerprint(distinct), record + nulls
    payload = np.concatenate(ids).astype(f"<u{width}").tobytes() if ids else b""
    parts = [MAGIC, payload + bytes(-len(payload) % 8), key.tobytes(), firsts.tobytes(),
             index.bits.tobytes(), marks.tobytes(), records.tobytes()]
    places = np.cumsum([0, *map(len, parts)]).tolist()
    footer = json.dumps({"width": width, "records": len(keys), "nulls": nulls, "slots": index.n,
                         "sizes": index.sizes, "rest": index.rest, "places": places}).encode()
    return b"".join([*parts, footer, len(footer).to_bytes(8, "little"), MAGIC])


class Shard:
    """A shard file's content, mapped or read; ``get`` touches a fixed number of places."""

    def __init__(self, data) -> None:
        self.data = memoryview(data)
        if bytes(self.data[-8:]) != MAGIC or bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a whole shard file")
        length = int.from_bytes(self.data[-16:-8], "little")
        f = self.footer = json.loads(bytes(self.data[-16 - length:-16]))
        at = f["places"]
        part = lambda i, kind, n: np.frombuffer(self.data, kind, n, at[i])
        self.keys, self.firsts = part(2, "<i8", f["records"]), part(3, "<i8", f["records"] + 1)
        self.ids = part(1, f"<u{f['width']}", int(self.firsts[-1]))
        self.index = PerfectHash(f["sizes"], part(4, "<u8", sum(f["sizes"]) // 64), f["rest"])
        self.marks, self.records = part(5, "<u4", f["slots"]), part(6, "<u4", f["slots"])

    def key(self, record: int) -> int | None:
        return None if record < self.footer["nulls"] else int(self.keys[record])

    def record(self, record: int) -> np.ndarray:
        return self.ids[self.firsts[record]:self.firsts[record + 1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 where the fingerprint or the stored key differs."""
        slot = self.index.slot(keys)
        out = np.full(len(keys), -1, np.int64)
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self.marks[slot[ok]] == fingerprint(keys[ok])]
        at = self.records[slot[ok]].astype(np.int64)
        same = self.keys[at] == keys[ok]
        out[ok[same]] = at[same]
        return out

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record under the key; an empty list where there is none."""
        at = int(self.find(np.array([key], np.int64))[0])
        out = []
        while 0 <= at < len(self.keys) and int(self.keys[at]) == key:
            out.append(self.record(at))
            at += 1
        return out

    def reached(self) -> tuple[list[int | None], np.ndarray]:
        """Key and number of every record: those without a key first, then the records under each key, the first
        of them as the hash index gives it, its fingerprint held against the key's."""
        nulls = self.footer["nulls"]
        keys, times = np.unique(self.keys[nulls:], return_counts=True)
        first = self.find(keys)
        if (first < 0).any():
            raise ValueError(f"the index does not lead to the records of key {keys[first < 0][0]}")
        if len(keys) and times.max() > 1:
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            keys, first = np.repeat(keys, times), np.repeat(first, times) + within
        if not np.array_equal(first, np.arange(nulls, len(self.keys))):
            raise ValueError("the index does not lead to every record")
        return [None] * nulls + keys.tolist(), np.r_[np.arange(nulls), first].astype(np.int64)


MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, first_key long, last_key long"


def write_ids(docs: DataFrame, root: str, tokenizer: str, end_id: int, width: int = 2,
              shard_ids: int = 2_000_000) -> None:
    """Encodes every whole text and writes shard files and their manifest under ``root``.

    ``root`` is a folder all executors reach, as a path or URI that pyarrow opens. Ranges of
    doc_id are dealt to tasks and sorted there; a file closes at ``shard_ids`` ids. Files have
    names of their own, and the manifest lists those of the attempts that counted, so a task
    that runs twice or dies leaves only an unlisted file behind.

    Null and empty texts give the end id alone. Null doc_ids come first and are not indexed;
    repeated ones are all kept. An empty table gives an empty manifest. Other columns are ignored.
    """
    if end_id >= 1 << 8 * width:
        raise ValueError("ids do not fit the width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(f"{root}/shards")
        store.create_dir(folder, recursive=True)
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        seq = held = 0

        def close():
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(shard_bytes(keys, ids, width))
            real = [k for k in keys if k is not None] or [None]
            return pa.record_batch([[part], [seq], [name], [len(keys)], [held], [real[0]], [real[-1]]],
                                   schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()),
                                                     ("file", pa.string()), ("n_docs", pa.int64()),
                                                     ("n_ids", pa.int64()), ("first_key", pa.int64()),
                                                     ("last_key", pa.int64())]))

        for batch in slices(batches):
            coded = code.encode(batch.column("text").to_pylist())
            for key, raw in zip(batch.column("doc_id").to_pylist(), coded):
                own = np.concatenate([np.frombuffer(raw, "<u4"), end])
                keys.append(key)
                ids.append(own.astype(f"<u{width}"))
                held += len(own)
                if held >= shard_ids:
                    yield close()
                    keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield close()

    (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST)
     .write.mode("overwrite").parquet(f"{root}/manifest"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The listed files, each with the number of ids in all files before it.

    The running sum is over one row per file, not per document.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
            .withColumn("ids_before", F.coalesce(F.sum("n_ids").over(order), F.lit(0))))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{root}/shards")
            .select(F.substring_index("path", "/", -1).alias("file"), "content"))


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every record of the store: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 over the ids as 32-bit integers, and file.

    Records are reached through the hash index, see ``Shard.reached``; a file whose index does not lead to all
    of them raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content")):
                s = Shard(content.as_buffer())
                key, record = s.reached()
                starts, ends = s.firsts[record], s.firsts[record + 1]
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(starts, pa.int64()),
                                       pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()),
                                       pa.array([file.as_py()] * len(key))],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    rows = _files(spark, root).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return (rows.join(manifest(spark, root).select("file", "ids_before"), "file")
            .select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens",
                    "ids_crc32", "file"))


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """The records under the given doc_ids through the index: doc_id, n_tokens, ids.

    Keys meet a file by its range in the manifest, then each file answers its keys from its hash
    index. Absent and null keys give no row, repeated keys one answer.
    """
    spark = keys.sparkSession
    listed = manifest(spark, root).select("file", "first_key", "last_key")
    asked = (keys.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
             .join(listed, F.col("doc_id").between(F.col("first_key"), F.col("last_key")))
             .groupBy("file").agg(F.sort_array(F.collect_list("doc_id")).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_keys, content in zip(batch.column("asked"), batch.column("content")):
                s = Shard(content.as_buffer())
                rows = [(k, x) for k in asked_keys.as_py() for x in s.get(k)]
                yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()),
                                       pa.array([len(x) for _, x in rows], pa.int64()),
                                       pa.array([x.tolist() for _, x in rows], pa.list_(pa.int32()))],
                                      names=["doc_id", "n_tokens", "ids"])

    return (_files(spark, root).join(asked, "file").select("asked", "content")
            .mapInArrow(run, "doc_id long, n_tokens long, ids array<int>"))
