"""Token-ID output: raw ids in binary shards, each with a minimal perfect hash index for keyed access.

Documents are dealt by ranges of doc_id and sorted, and shards follow each other in the order of their first keys,
whatever their files are called. A shard is closed when its payload passes ``shard_bytes``. It is written by Spark's own file writer (one row, one
file), so it works on any file system that Spark writes to, and a lost task is simply run again.

A shard: magic, counts, end id and seed (HEADER); displacements (int32, one for each bucket); for each slot the
key's 32-bit fingerprint, whether its doc_id is null, doc_id, start and length in ids; the payload. A key's first
hash names its bucket; the bucket's displacement and two more hashes name its slot, or the displacement names the
slot itself (buckets of one key). No slot stays empty, and a lookup takes one bucket, one slot and one comparison;
a key that is not in the shard is told by the fingerprint and the stored key.

Nulls: a null text is empty (only the end id); a null doc_id is stored as such, after all others. Rows that repeat a
doc_id are kept, in order of their text hash, under (doc_id, occurrence). Invalid UTF-8 is read with U+FFFD. An empty
table gives no shards and no rows. A very long text fills a shard alone. Columns of any name pass untouched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, keyed, new_path, saved, small, table
from .tokens import default_path, encoder

MAGIC = b"FLTOKID1"
HEADER = struct.Struct("<8sIIBIQQ")  # magic, keys, buckets, bytes an id, end id, seed, payload ids
SLOT = np.dtype([("mark", "<u4"), ("null", "u1"), ("occurrence", "<u4"), ("doc_id", "<i8"), ("start", "<u8"), ("length", "<u8")])
SHARD_BYTES = 8 << 20
END_ID = 2
KEYS_PER_BUCKET = 4


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Bucket hash, two slot hashes and the stored fingerprint of each key."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = mix(doc_id.astype(np.int64).view(np.uint64) ^ mix((occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)) * step + np.uint64(seed)))
        return mix(key + step), mix(key + step * np.uint64(2)), mix(key + step * np.uint64(3)), (mix(key + step * np.uint64(4)) >> np.uint64(32)).astype(np.uint32)


def place(h0: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Displacements and the slot of each key; None if two keys can't be told apart with this seed."""
    n = len(h0)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (h0 % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    shift, slots, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    tries = np.arange(64, dtype=np.uint64)[:, None]
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        keys = order[starts[b] : starts[b + 1]]
        d = np.uint64(0)
        with np.errstate(over="ignore"):
            while True:
                at = ((h1[keys] + (tries + d) * (h2[keys] | np.uint64(1))) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(at, axis=1)
                good = free[at].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    break
                d += np.uint64(64)
                if d > 1 << 22:
                    return None
        i = int(np.argmax(good))
        shift[b], slots[keys] = int(d) + i, at[i]
        free[at[i]] = False
    alone = np.flatnonzero(sizes == 1)
    rest = np.flatnonzero(free)
    shift[alone] = -rest - 1
    slots[order[starts[alone]]] = rest
    return shift, slots


def pack_shard(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray, ids: list[bytes], kind: np.dtype, end_id: int) -> bytes:
    lengths = np.array([len(x) // kind.itemsize for x in ids], np.uint64)
    for seed in range(1 << 10):
        h0, h1, h2, mark = hashes(doc_id, null, occurrence, seed)
        if (placed := place(h0, h1, h2)) is not None:
            break
    else:
        raise ValueError("keys repeat in a shard")
    shift, slots = placed
    rows = np.zeros(len(ids), SLOT)
    starts = np.cumsum(lengths) - lengths
    for name, values in (("mark", mark), ("null", null), ("occurrence", occurrence), ("doc_id", doc_id), ("start", starts), ("length", lengths)):
        rows[name][slots] = values
    head = HEADER.pack(MAGIC, len(ids), len(shift), kind.itemsize, end_id, seed, int(lengths.sum()))
    return b"".join([head, shift.astype("<i4").tobytes(), rows.tobytes(), *ids])


class Shard:
    """A shard's bytes, with constant-time access by key."""

    def __init__(self, content: bytes):
        magic, self.keys, self.buckets, width, self.end_id, self.seed, self.total = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.shift = np.frombuffer(content, "<i4", self.buckets, at)
        self.slots = np.frombuffer(content, SLOT, self.keys, at := at + 4 * self.buckets)
        self.ids = np.frombuffer(content, f"<u{width}", self.total, at + SLOT.itemsize * self.keys)

    def find(self, doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the shard doesn't hold it."""
        h0, h1, h2, mark = hashes(doc_id, null, occurrence, self.seed)
        d = self.shift[(h0 % np.uint64(self.buckets)).astype(np.int64)].astype(np.int64)
        with np.errstate(over="ignore"):
            at = ((h1 + d.astype(np.uint64) * (h2 | np.uint64(1))) % np.uint64(self.keys)).astype(np.int64)
        slot = np.where(d < 0, -d - 1, at)
        found = self.slots[slot]
        same = (found["mark"] == mark) & (found["doc_id"] == doc_id) & (found["null"] == null) & (found["occurrence"] == occurrence)
        return np.where(same, slot, -1)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, the end id included."""
        slot = int(self.find(np.array([doc_id or 0]), np.array([doc_id is None], np.uint8), np.array([occurrence], np.uint32))[0])
        if slot < 0:
            return None
        row = self.slots[slot]
        return self.ids[int(row["start"]) : int(row["start"] + row["length"])]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text and write the shards under path."""

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], tokens.kind).tobytes()
        ids: list[bytes] = []
        keys: list[tuple[int, int, int]] = []
        size, last, occurrence = 0, None, 0

        def shard() -> pd.DataFrame:
            k = np.array(keys, np.int64)
            return pd.DataFrame({"value": [pack_shard(k[:, 0], k[:, 1].astype(np.uint8), k[:, 2].astype(np.uint32), ids, tokens.kind, end_id)]})

        for pdf in it:
            for known, doc_id, found in zip(pdf["known"], pdf["row_id"], tokens.each(pdf["body"])):
                key = (int(doc_id) if known else 0, int(not known))
                occurrence = occurrence + 1 if key == last else 0
                last = key
                ids.append(found + end)
                keys.append((*key, occurrence))
                size += len(ids[-1])
                if size >= shard_bytes:
                    yield shard()
                    ids, keys, size = [], [], 0
        if ids:
            yield shard()
        give_back()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, F.col("doc_id").isNotNull().alias("known")).select("known", "row_id", "row_hash", F.col("text").cast("binary").alias("body"))
    ordered = rows.repartitionByRange(n, F.desc("known"), F.col("row_id")).sortWithinPartitions(F.desc("known"), "row_id", "row_hash")
    blobs = ordered.drop("row_hash").mapInPandas(encode, "value binary")
    blobs.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: each document looked up by its key."""

    def look_up(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"]):
                if not content.startswith(MAGIC):
                    continue  # the writer's file of an empty partition
                s = Shard(content)
                slot = s.find(s.slots["doc_id"], s.slots["null"], s.slots["occurrence"])
                if not (np.sort(slot) == np.arange(s.keys)).all():
                    raise ValueError(f"{name}: the index is damaged")
                rows = s.slots[slot]
                ids = [s.ids[a : a + n] for a, n in zip(rows["start"].tolist(), rows["length"].tolist())]
                head = s.slots[np.flatnonzero((s.slots["start"] == 0) & (s.slots["length"] > 0))[0]]  # each holds the end id at least
                out = {"shard": name.rpartition("/")[2], "null_key": bool(head["null"]), "first_key": int(head["doc_id"]), "copy": int(head["occurrence"])}
                out |= {"doc_id": pd.array(rows["doc_id"], "Int64"), "local": rows["start"].astype(np.int64), "n_tokens": rows["length"].astype(np.int64)}
                out["doc_id"][rows["null"] == 1] = pd.NA
                yield pd.DataFrame(out | {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    row = "shard string, null_key boolean, first_key long, copy long, doc_id long, local long, n_tokens long, ids_crc32 long"
    found = saved(files.mapInPandas(look_up, row), "shard-rows")
    starts = small(saved(shard_starts(found), "shard-starts"), 120)
    return found.join(starts, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def shard_starts(found: DataFrame) -> DataFrame:
    """shard, before: the ids of all shards before it, in the order of their first keys.

    Ranges of shards are summed side by side; only the sums of the ranges, one row each, meet in one window."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["null_key", "first_key", "copy"]
    shards = found.groupBy("shard", *keys).agg(F.sum("n_tokens").alias("n"))
    ranged = saved(shards.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()), "shard-sizes")
    within = F.sum("n").over(Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ranged.withColumn("within", within).join(F.broadcast(ranges.select("range", earlier.alias("earlier"))), "range").select("shard", (F.col("within") + F.col("earlier")).alias("before"))


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, default_path())
    return read_shards(spark, path)
