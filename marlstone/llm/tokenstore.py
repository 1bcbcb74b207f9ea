"""Token ids as raw binary shards with a minimal perfect hash index.

Each task writes the ids of its documents end to end into one shard file, little-endian and
without separators, under a name that holds the task attempt, so a retried or speculative attempt
never touches another's file; files of attempts that failed are in no index.  The index maps a
document key to (shard, offset, length): keys are spread over buckets by hash, each bucket is a
minimal perfect hash over its keys (levels of bits in which a key that collides moves on to the
next level, ranked by population count) with a fingerprint per slot, so a key that was never stored
is told apart.  A bucket's file holds its ranks too, so getting one key reads a word a level, one
block of words, one slot and one byte range, however many keys there are.  A lookup of a whole table
brings keys to their buckets and entries to their shards, so each is read once and in order.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spm
from . import textkernel as K
from .common import bounded_batches, lean, shared_dir, written

MAGIC = b"MPH2"
#: Words between two stored ranks, and bytes between two ranges below which they are read as one.
RANK_WORDS, GAP = 8, 1 << 16
ENTRY = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4"), ("crc", "<u4")])
#: Room per key in each level's bits.
GAMMA = 2.0


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return K.mix(K.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)))


class PerfectHash:
    """Slots 0..n-1 of n distinct integer keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.first = np.cumsum([0, *(len(x) for x in levels)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.int64), []
        while len(left):
            size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = (_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot or -1 for a key that isn't one of the n."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_hash(keys[left], i) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.rank[self.first[i] + (at >> 6)] + below)[hit]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray, crc: np.ndarray, names: list[str]) -> bytes:
    """One bucket of the index; shard numbers point into ``names``."""
    mph = PerfectHash.build(keys)
    table = np.zeros(len(keys), ENTRY)
    slot = mph.slots(keys)
    for f, v in (("fp", fingerprint(keys)), ("shard", shard), ("offset", offset), ("n", n), ("crc", crc)):
        table[f][slot] = v
    listed = "\n".join(names).encode()
    head = MAGIC + struct.pack("<III", len(keys), len(mph.levels), len(listed)) + struct.pack(f"<{len(mph.levels)}I", *(len(x) for x in mph.levels))
    ranks = mph.rank[: len(mph.words) : RANK_WORDS].astype("<u4")
    return head + mph.words.astype("<u8").tobytes() + ranks.tobytes() + table.tobytes() + listed


class Bucket:
    """A bucket read back."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not an index")
        n, levels, listed = struct.unpack_from("<III", blob, 4)
        sizes = struct.unpack_from(f"<{levels}I", blob, 16)
        at, parts = 16 + 4 * levels, []
        for s in sizes:
            parts.append(np.frombuffer(blob, "<u8", s, at).astype(np.uint64))
            at += 8 * s
        at += 4 * -(-sum(sizes) // RANK_WORDS)
        self.mph, self.table = PerfectHash(parts), np.frombuffer(blob, ENTRY, n, at)
        names = blob[at + n * ENTRY.itemsize :].decode()
        self.names = names.split("\n") if listed else []

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is stored, its entry)."""
        slot = self.mph.slots(keys)
        if not len(self.table):
            return np.zeros(len(keys), bool), np.zeros(len(keys), ENTRY)
        rows = self.table[np.maximum(slot, 0)]
        return (slot >= 0) & (rows["fp"] == fingerprint(keys)), rows


class Slots:
    """A bucket's file read a few bytes at a time: only its head is held."""

    def __init__(self, f: pa.NativeFile):
        self.file = f
        head = f.read_at(16, 0)
        if head[:4] != MAGIC:
            raise ValueError("not an index")
        self.n, levels, self.listed = struct.unpack_from("<III", head, 4)
        self.sizes = struct.unpack(f"<{levels}I", f.read_at(4 * levels, 16)) if levels else ()
        self.words = 16 + 4 * levels
        self.ranks = self.words + 8 * sum(self.sizes)
        self.table = self.ranks + 4 * -(-sum(self.sizes) // RANK_WORDS)

    def find(self, key: int) -> tuple[np.void, str] | None:
        """(entry, shard's name) of a key; None if it isn't stored."""
        k, first = np.array([key], np.int64), 0
        for level, size in enumerate(self.sizes):
            at = int(_hash(k, level)[0] % np.uint64(size * 64))
            word = first + (at >> 6)
            block = word - word % RANK_WORDS
            held = np.frombuffer(self.file.read_at(8 * (word - block + 1), self.words + 8 * block), "<u8")
            if int(held[-1]) >> (at & 63) & 1:
                (rank,) = struct.unpack("<I", self.file.read_at(4, self.ranks + 4 * (block // RANK_WORDS)))
                slot = rank + int(np.bitwise_count(held[:-1]).sum()) + (int(held[-1]) & ((1 << (at & 63)) - 1)).bit_count()
                row = np.frombuffer(self.file.read_at(ENTRY.itemsize, self.table + slot * ENTRY.itemsize), ENTRY)[0]
                return (row, self.name(int(row["shard"]))) if row["fp"] == fingerprint(k)[0] else None
            first += size
        return None

    def name(self, shard: int) -> str:
        if not hasattr(self, "_names"):
            self._names = self.file.read_at(self.listed, self.table + self.n * ENTRY.itemsize).decode().split("\n")
        return self._names[shard]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 1 << 21) % np.uint64(buckets)).astype(np.int64)


class Store:
    """Keyed access to the ids of a store directory."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        with self.fs.open_input_file(posixpath.join(self.root, "manifest")) as f:
            lines = f.read().decode().split("\n")
        self.width, self.files = int(lines[0]), lines[1:]
        self.buckets: dict[int, Bucket] = {}
        self.slots: dict[int, Slots] = {}
        self.open: dict[str, pa.NativeFile] = {}

    def _read(self, name: str, offset: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(posixpath.join(self.root, name))
        return self.open[name].read_at(size, offset) if size else b""

    def bucket(self, i: int) -> Bucket:
        """A bucket as a whole, for many keys; the last one is held."""
        if i not in self.buckets:
            self.buckets.clear()
            with self.fs.open_input_file(posixpath.join(self.root, self.files[i])) as f:
                self.buckets[i] = Bucket(f.read())
        return self.buckets[i]

    def get(self, key: int) -> np.ndarray | None:
        """Ids of a document, None if it isn't stored."""
        if not self.files:
            return None
        i = int(bucket_of(np.array([key], np.int64), len(self.files))[0])
        if i not in self.slots:
            if len(self.slots) >= 64:
                self.slots.pop(next(iter(self.slots))).file.close()
            self.slots[i] = Slots(self.fs.open_input_file(posixpath.join(self.root, self.files[i])))
        hit = self.slots[i].find(key)
        if hit is None:
            return None
        row, name = hit
        return np.frombuffer(self._read(name, int(row["offset"]), int(row["n"]) * self.width), f"<u{self.width}")

    def ranges(self, name: str, offset: np.ndarray, size: np.ndarray, most: int = 8 << 20):
        """Yields (position, bytes) of ranges of one shard in ascending order, near ones read together."""
        at = 0
        while at < len(offset):
            to = at + 1
            while to < len(offset) and offset[to] - (offset[to - 1] + size[to - 1]) <= GAP and offset[to] + size[to] - offset[at] <= most:
                to += 1
            end = int((offset[at:to] + size[at:to]).max())
            part = self._read(name, int(offset[at]), end - int(offset[at]))
            for i in range(at, to):
                a = int(offset[i] - offset[at])
                yield i, part[a : a + int(size[i])]
            at = to


def build(docs: DataFrame, uri: str | None = None, model_file: str | None = None, keys_per_bucket: int = 1_000_000) -> str:
    """Writes the ids of docs and their index below ``uri`` (by default in the shared folder) and returns it.

    A null or empty text is stored as no ids.  Rows without doc_id have no key and aren't stored.
    Of rows that share a doc_id, the one with the smallest text hash is indexed (equal rows: any
    of them, with equal ids).  Texts of any length are stored whole.  Other columns are ignored.
    An empty table gives an empty store.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    uri = uri or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    filesystem, root = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(root)
    model = spm.Model.load(model_file or spm.default_model())
    held = spark.sparkContext.broadcast(model)
    width = 2 if spm.encoder(model).sp.vocab_size() <= 1 << 16 else 4

    def shards(batches):
        enc = spm.encoder(held.value)
        out, at, out_fs = None, 0, None
        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.bin"
        for b in batches:
            data, off = K.text_buffers(b.column(2))
            for lo, hi in K.chunks(off):
                per, ids, _, _ = enc.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], spans=False)
                raw = ids.astype(f"<u{width}").tobytes()
                if out is None:
                    out_fs, out_root = pafs.FileSystem.from_uri(uri)
                    out = out_fs.open_output_stream(posixpath.join(out_root, name))
                out.write(raw)
                cut = np.concatenate([[0], np.cumsum(per)]) * width
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                n = hi - lo
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array([name] * n), pa.array(cut[:-1] + at), pa.array(per), pa.array(crc, pa.int64())], names=["key", "rid", "shard", "offset", "n", "crc"])
                at += len(raw)
        if out is not None:
            out.close()

    src = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text")).where("key is not null")
    entries = written(src.mapInArrow(lean(shards), "key long, rid long, shard string, offset long, n long, crc long"), "token-entries")
    total = entries.count()
    buckets = max(1, -(-total // keys_per_bucket))

    def spread(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0).to_numpy(), buckets)), *b.columns], names=["bucket", *b.schema.names])

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("rid", "ascending"), ("shard", "ascending"), ("offset", "ascending")])
        keys = table["key"].to_numpy()
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        table = table.filter(pa.array(first))
        shard = table["shard"].combine_chunks().dictionary_encode()
        blob = pack_index(table["key"].to_numpy(), shard.indices.to_numpy(), *(table[c].to_numpy() for c in ("offset", "n", "crc")), shard.dictionary.to_pylist())
        bucket = table["bucket"][0].as_py()
        name = f"index-{bucket:05d}-{uuid.uuid4().hex[:8]}.mph"
        out_fs, out_root = pafs.FileSystem.from_uri(uri)
        with out_fs.open_output_stream(posixpath.join(out_root, name)) as f:
            f.write(blob)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "name": [name]})

    tagged = entries.mapInArrow(lean(spread), "bucket long, key long, rid long, shard string, offset long, n long, crc long")
    made = {r["bucket"]: r["name"] for r in tagged.groupBy("bucket").applyInArrow(index, "bucket long, name string").collect()} if total else {}
    if total:
        for b in range(buckets):  # a bucket that no key fell into
            if b not in made:
                made[b] = f"index-{b:05d}-none.mph"
                with filesystem.open_output_stream(posixpath.join(root, made[b])) as f:
                    f.write(pack_index(*(np.zeros(0, np.int64) for _ in range(5)), []))
    with filesystem.open_output_stream(posixpath.join(root, "manifest")) as f:
        f.write("\n".join([str(width), *(made[b] for b in sorted(made))]).encode())
    return uri


FOUND = "doc_id long, shard string, byte_offset long, n_ids long, crc32 long"


def lookup(keys: DataFrame, uri: str) -> DataFrame:
    """(doc_id, shard, byte_offset, n_ids, crc32, intact) of each row of keys, by the index alone.

    ``intact``: the payload that the index points at has the stored checksum.  A key that isn't
    stored has nulls and isn't intact; rows without doc_id are dropped; repeated keys give repeated
    rows.  Other columns, whatever their names, are ignored; an empty table gives no row.
    """
    buckets = len(Store(uri).files)

    def spread(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0).to_numpy(), max(1, buckets))), b.column(0)], names=["bucket", "doc_id"])

    def find(batches):
        store = Store(uri)
        for b in batches:
            which, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in _stretches(which):
                n = hi - lo
                if buckets:
                    bucket = store.bucket(int(which[lo]))
                    there, rows = bucket.find(ids[lo:hi])
                    names = pa.array(bucket.names, pa.string()).take(pa.array(rows["shard"].astype(np.int64), mask=~there)) if bucket.names else pa.nulls(n, pa.string())
                else:
                    there, rows, names = np.zeros(n, bool), np.zeros(n, ENTRY), pa.nulls(n, pa.string())
                col = lambda f: pa.array(rows[f].astype(np.int64), mask=~there)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), names, col("offset"), col("n"), col("crc")], names=[x.split()[0] for x in FOUND.split(", ")])

    def check(batches):
        store = Store(uri)
        for b in batches:
            names, n = b.column(1), len(b)
            ok, code = np.zeros(n, bool), names.dictionary_encode()
            shard = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            offset, count, crc = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for lo, hi in _stretches(shard):
                if shard[lo] >= 0:
                    for i, part in store.ranges(code.dictionary[int(shard[lo])].as_py(), offset[lo:hi], count[lo:hi] * store.width):
                        ok[lo + i] = zlib.crc32(part) == crc[lo + i]
            short = pa.array([x.split("-")[1] if x else None for x in names.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), short, *b.columns[2:], pa.array(ok)], names=[*b.schema.names, "intact"])

    ids = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    found = ids.mapInArrow(lean(spread), "bucket long, doc_id long").repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(lean(find), FOUND)
    # keys that aren't stored are spread
    return found.repartition(F.coalesce("shard", F.col("doc_id").cast("string"))).sortWithinPartitions("shard", "byte_offset").mapInArrow(lean(check), FOUND + ", intact boolean")


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return list(zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(values)]]).tolist(), strict=True)) if len(values) else []
