"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at ``RADIUS`` = 3 differing bits or fewer. Half the radius is one bit: every distinct
fingerprint emits itself and its one-bit flips, so any two within two bits share a variant. For the odd third bit one of
four 16-bit blocks is masked at a time, and the flips are those of the other 48 bits: two fingerprints three bits apart
meet under the mask that covers one of the three. That is 4 * 49 variants a fingerprint, whatever the data.

A bucket (mask, variant) holds at most 49 * 2^16 fingerprints, so it fits a task even if all documents are near copies.
Buckets of a few are compared in full. In larger ones no pairs are emitted:

* equal masked bits: any two differ by the two flips at most, so each links to the first;
* masked bits one apart: any two differ by three bits at most, so their first ones link;
* the others that lie three bits apart with all three in the mask, found by probing the 560 flips of the unflipped.

Two bits in the mask and one flip is the case of another mask, with one bit in the mask and two flips.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import connected_components

RADIUS = 3
BLOCK = 16
SMALL = 256
#: Rows for each task that emits variants.
TASK_ROWS = 20_000


def _votes(h: np.ndarray) -> np.ndarray:
    out = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        out += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    w = text.lower().split()  # of bytes: A-Z only, and [\x20\x09-\x0D] only
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype=np.uint64)
    return int(np.packbits((_votes(h) * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the 64 bits as a long). Null text: as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t for at in range(0, b.num_rows, 500) for t in b.column(2).slice(at, 500).to_pylist())
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in texts), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])
            release()

    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary"))
    return cols.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """``mask, key, fp``: each fingerprint with its bits outside each block, none or one of them flipped."""
    rows = []
    for k in range(64 // BLOCK):
        hidden = ((1 << BLOCK) - 1) << (k * BLOCK)
        rows += [(k, ~hidden, f) for f in [0, *(1 << i for i in range(64) if not hidden >> i & 1)]]
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    table = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.lit(signed(keep)).cast("bigint").alias("keep"), F.lit(signed(f)).cast("bigint").alias("flip")) for k, keep, f in rows])
    v = fps.select("fp", F.explode(table).alias("v"))
    return v.select(F.col("v.k").alias("mask"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links reach from each of 0..n-1."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _in_bucket(mask: int, key: int, fp: np.ndarray) -> np.ndarray:
    """For each of a bucket's distinct fingerprints the index of the first that its links reach."""
    n = len(fp)
    if n <= SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS, 1))
        return _settle(n, a, b)
    hidden = np.uint64(((1 << BLOCK) - 1) << (mask * BLOCK))
    m = ((fp & hidden) >> np.uint64(mask * BLOCK)).astype(np.int64)
    values, first, group = np.unique(m, return_index=True, return_inverse=True)
    a, b = [np.arange(n)], [first[group]]
    at = np.full(1 << BLOCK, -1)
    at[values] = first
    for i in range(BLOCK):
        to = at[values ^ (1 << i)]
        a.append(first[to >= 0])
        b.append(to[to >= 0])
    plain = np.nonzero((fp & ~hidden) == np.uint64(key))[0]
    at = np.full(1 << BLOCK, -1)
    at[m[plain]] = plain
    for x, y, z in combinations(range(BLOCK), 3):
        to = at[m[plain] ^ (1 << x | 1 << y | 1 << z)]
        a.append(plain[to >= 0])
        b.append(to[to >= 0])
    return _settle(n, np.concatenate(a), np.concatenate(b))


def _links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Pairs of fingerprints, enough to join what links join, of whole buckets in order."""
    new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    start = np.nonzero(new)[0]
    size = np.diff(np.append(start, len(key)))
    out = [np.empty((0, 2), dtype=np.uint64)]
    few = np.repeat(size <= 8, size)
    of = np.repeat(np.arange(len(start)), size)
    for d in range(1, min(8, int(size.max()))):
        i = np.nonzero(few[:-d] & (of[:-d] == of[d:]))[0]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
        out.append(np.stack([fp[i], fp[i + d]], axis=1))
    for s, n in zip(start[size > 8], size[size > 8], strict=True):
        own = np.unique(fp[s : s + n])
        lab = _in_bucket(int(mask[s]), int(key[s]), own)
        i = np.nonzero(lab != np.arange(len(own)))[0]
        out.append(np.stack([own[i], own[lab[i]]], axis=1))
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: the links of each bucket; the last bucket of a batch waits for the next."""
    held = [np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)]

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if met.any():
            pairs = _links(*(c[met] for c in cols)).view(np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        new = [np.concatenate([h, c.to_numpy(zero_copy_only=False).view(h.dtype)]) for h, c in zip(held, batch.columns, strict=True)]
        last = np.nonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))[0] if len(new[0]) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from emit([c[:cut] for c in new])
        held = [c[cut:] for c in new]
    if len(held[0]):
        yield from emit(held)
    release()


def near_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct values of ``fp``, enough to join all that direct links join."""
    # a few bytes a fingerprint, but 196 variants: dealt out by number, not by size
    tasks = max(1, min(65_536, -(-fps.count() // TASK_ROWS)))
    v = variants(fps.select("fp").distinct().repartition(tasks, "fp")).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return v.mapInArrow(_meet, "a bigint, b bigint").distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id, text_hash, group``: the smallest id that links of 3 bits or fewer reach, one row per row
    of ``docs``; a hash of its text; and the smallest fingerprint that links reach, which tells groups apart.

    Documents of one fingerprint are one node, so a group of copies of any size is one min per task. Null or empty
    texts: fingerprint zero, linked like any other. Null ids: given the smallest id of their group, null if it has
    none. Rows that repeat an id: linked as any. Empty table: no rows.
    """
    own = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("__least"))
    node = connected_components(near_links(own))
    joined = node.join(least, node["node"] == least["fp"]).select("component", "fp", "__least")
    lowest = joined.groupBy("component").agg(F.min("__least").alias("__lowest"))
    merged = joined.join(lowest, "component").select(F.col("fp").alias("__fp"), "__lowest", "component")
    # a group without any id has no smallest one, and is a group all the same
    own_id = F.when(F.col("component").isNull(), F.col("__least")).otherwise(F.col("__lowest"))
    every = least.join(merged, F.col("fp") == F.col("__fp"), "left").select(F.col("fp").alias("__fp"), own_id.alias("component_id"), F.coalesce("component", "fp").alias("group"))
    # written, so that both sides of the last join are shuffled as they are and AQE can split a hot fingerprint's rows
    every = materialize(every, "simhash-groups")
    return own.join(every, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id", "text_hash", "group")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
