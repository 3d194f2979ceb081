"""Token-ID output in training order.

Texts become piece ids, packed into sequences of a fixed length; a keyed Feistel permutation with cycle-walking gives
every sequence its slot among all; ranges of slots become shards of a fixed stride. Slot s is in shard s // per_shard at
byte s % per_shard * stride, so any run of the training order is one read, and a reader resumes from a slot's number.

Which texts share a sequence follows from the rows alone: documents are dealt to buckets by a hash of id and text, and
packed bucket by bucket in the order of that hash, however files and tasks cut the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, runs
from .pieces import MODEL, encoder, let_go

END, PAD = 2, 0
ROUNDS = 8
#: Documents a bucket, on average, and buckets at most. Each bucket's last sequence is filled up.
BUCKET, BUCKETS = 8_192, 65_536


def _zip(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def _unzip(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, size, "zstd", asbytes=True)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def feistel(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked until it is in range.

    The network is a permutation of under 4n values, so a walk is four steps on average and always returns.
    """
    half = np.uint64(max(1, math.ceil((int(n) - 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(hashlib.sha256(f"{seed},{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int = 1024, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, place, n_tokens, first_doc, ids``: the texts of each bucket, an end mark after each, cut into sequences.

    ``ids`` holds ``length`` unsigned 16-bit numbers, little-endian, as zstd; a bucket's last sequence is filled up with
    ``PAD``. Null and empty texts are an end mark. Null ids are ids like any other. ``first_doc`` is the id of the
    document that the sequence starts in.
    """
    buckets = max(1, min(BUCKETS, math.ceil(docs.count() / BUCKET)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, 0.0, 0)
        if enc.pieces.size > 1 << 16:
            raise ValueError("ids of 16 bits are too short for this model")
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                flat, ends = enc.encode_flat([t or "" for t in some.column(3).to_pylist()])
                raw = np.insert(flat, ends, END).astype("<u2").tobytes()
                ends = 2 * (ends + np.arange(1, len(ends) + 1))
                blobs = [_zip(raw[s:e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(np.diff(ends, prepend=0) // 2), pa.array(blobs, pa.binary())], ["bucket", "o", "doc_id", "n", "ids"])
            release()
        let_go()

    order = F.xxhash64(F.col(id_col), F.col(text_col))
    cols = docs.select(F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"), order.alias("o"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    made = cols.mapInArrow(encoded, "bucket int, o bigint, doc_id bigint, n bigint, ids binary")
    dealt = made.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "o", "doc_id", "ids")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # of the current bucket: texts not yet cut, and whose they are
        starts: list[int] = []
        owners: list[int | None] = []
        size, place, bucket = 0, 0, None

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal held, starts, owners, size, place
            raw = b"".join(held)
            whole = -(-size // length) if last else size // length
            real = np.full(whole, length)
            if whole * length > size:
                raw += np.full(whole * length - size, PAD, dtype="<u2").tobytes()
                real[-1] = size - (whole - 1) * length
            heads = np.arange(whole + 1) * length
            first = [owners[i] for i in (np.searchsorted(starts, heads, side="right") - 1).tolist()]
            blobs = [_zip(raw[2 * i : 2 * (i + length)]) for i in heads[:-1].tolist()]
            out = pa.RecordBatch.from_arrays([pa.array([bucket] * whole, pa.int32()), pa.array(np.arange(place, place + whole)), pa.array(real), pa.array(first[:-1], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "place", "n_tokens", "first_doc", "ids"])
            place += whole
            held, size = [raw[2 * whole * length :]], max(0, size - whole * length)
            starts, owners = [0], [first[-1]]
            return out

        for b in batches:
            for k, doc, n, blob in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if k != bucket:
                    if size:
                        yield cut(True)
                    held, starts, owners, size, place, bucket = [], [], [], 0, 0, k
                held.append(_unzip(blob, 2 * n))
                starts.append(size)
                owners.append(doc)
                size += n
                if size > 1 << 21:
                    yield cut(False)
            release()
        if size:
            yield cut(True)

    return dealt.mapInArrow(packed, "bucket int, place bigint, n_tokens bigint, first_doc bigint, ids binary")


def training_shards(docs: DataFrame, length: int = 1024, per_shard: int = 2048, seed: int = 4, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, first_slot, n_sequences, stride, n_tokens, sha256, payload``: all sequences in training order.

    A payload is ``n_sequences`` runs of ``stride`` bytes; all shards but the last hold ``per_shard``. Ids move once to
    their bucket and, as sequences, once to the range of slots they belong to; in between they are in the shared folder,
    so that their number is known and no text is encoded twice. Equal rows give equal shards, however the table is cut.
    Rows that repeat are encoded each. Empty table: no shards.
    """
    spark = docs.sparkSession
    made = materialize(token_sequences(docs, length, model, id_col, text_col), "sequences")
    sizes = made.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect()  # ``BUCKETS`` rows at most
    total = sum(r["n"] for r in sizes)
    starts, at = {}, 0
    for r in sizes:
        starts[r["bucket"]] = at
        at += r["n"]
    shards = max(1, math.ceil(total / per_shard))
    parts = min(shards, 8192)
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "bucket int, start bigint")

    @F.pandas_udf("bigint")
    def slot_of(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), total, seed))

    placed = made.join(F.broadcast(offsets), "bucket").withColumn("slot", slot_of(F.col("start") + F.col("place")))
    placed = placed.select(F.floor(F.col("slot") / per_shard).alias("shard"), "slot", "n_tokens", "ids")
    ranged = placed.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("shard", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            payload = b"".join(_unzip(x, 2 * length) for x in t.column("ids").to_pylist())
            row = [t.column("shard")[0].as_py(), t.column("slot")[0].as_py(), t.num_rows, 2 * length, sum(t.column("n_tokens").to_pylist()), hashlib.sha256(payload).hexdigest(), payload]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "first_slot", "n_sequences", "stride", "n_tokens", "sha256", "payload"), row, strict=True))])

    return ranged.mapInArrow(run, "shard bigint, first_slot bigint, n_sequences bigint, stride bigint, n_tokens bigint, sha256 string, payload binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(shards: DataFrame, uri: str) -> DataFrame:
    """Writes each shard as a file of its own under ``uri`` (any that Arrow opens); returns what it wrote.

    A file is written under another name and then moved, so a task that is run again leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for b in batches:
            for r in b.to_pylist():
                name = f"{root}/{shard_name(r['shard'])}"
                part = f"{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(r["payload"])
                store.move(part, name)
            yield b.drop_columns(["payload"])

    return shards.mapInArrow(run, "shard bigint, first_slot bigint, n_sequences bigint, stride bigint, n_tokens bigint, sha256 string")


def read_slots(uri: str, first: int, n: int, length: int = 1024, per_shard: int = 2048) -> np.ndarray:
    """Up to n sequences of the training order from slot ``first`` on, by seeking in the files of ``write_shards``."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    out, stride = [], 2 * length
    while n > 0:
        name = f"{root}/{shard_name(first // per_shard)}"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break
        here = min(n, per_shard - first % per_shard)
        with store.open_input_file(name) as f:
            f.seek(first % per_shard * stride)
            got = np.frombuffer(f.read(here * stride), dtype="<u2").reshape(-1, length)
        out.append(got)
        first, n = first + len(got), n - here
        if len(got) < here:
            break
    return np.concatenate(out) if out else np.empty((0, length), dtype="<u2")


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    return training_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
