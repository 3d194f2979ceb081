"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks in the buckets.

On unit vectors a cosine of t is a distance of sqrt(2 - 2t). A table cuts ``k`` Gaussian projections into cells of
``width`` times that distance; vectors in the same cell of a table are compared exactly. As the theory has it, k grows
with the logarithm of the number of vectors, so that unrelated vectors seldom meet, and the number of tables keeps the
chance that a pair at the threshold itself meets in one of them at ``recall``; nearer pairs meet almost surely.

Only buckets of two or more fetch their vectors. A bucket over ``CHUNK`` vectors is dealt out as pairs of chunks, so a
hot one is many small matrix products; counts and one link a vector leave a task, never pairs. Nothing that grows with
the vectors is broadcast, as that passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized
from .components import connected_components

CHUNK = 512


def _same_cell(width: float) -> float:
    """The chance that one p-stable hash of cells ``width`` joins two vectors at distance 1."""
    tail = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def plan_tables(n: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """``k`` and the number of tables for n vectors: one meets an unrelated one, at right angles, once in 32 tables."""
    near = math.sqrt(2 - 2 * threshold)
    p1, p2 = _same_cell(width), _same_cell(width * near / math.sqrt(2))
    k = max(4, math.ceil(math.log(32 * max(n, 2)) / -math.log(p2)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p1**k))


class Tables:
    """The hash functions; the same in every process, as they are drawn from the seed."""

    def __init__(self, k: int, tables: int, cell: float, seed: int) -> None:
        self.k, self.tables, self.cell, self.seed, self.by_dim = k, tables, cell, seed, {}

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each unit vector in each table."""
        d = unit.shape[1]
        if d not in self.by_dim:
            rng = np.random.default_rng([self.seed, d])
            self.by_dim[d] = rng.standard_normal((d, self.tables * self.k)), rng.uniform(0, 1, self.tables * self.k), rng.integers(1, 2**62, self.tables * self.k) * 2 + 1
        proj, shift, mix = self.by_dim[d]
        cell = np.floor(unit @ proj / self.cell + shift).astype(np.int64) * mix
        return cell.reshape(len(unit), self.tables, self.k).sum(axis=2) * 0x9E3779B1 + d


def unit_vectors(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: rows and their vectors at length one, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for d in np.unique(sizes):
        rows = np.nonzero(sizes == d)[0]
        v = flat[starts[rows][:, None] + np.arange(d)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        out.append((int(d), rows, v / np.linalg.norm(v, axis=1, keepdims=True)))
    return out


def _compare(table: int, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, cells: np.ndarray, chunk: np.ndarray, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For one block of a bucket: the weight each vector links to here first, and the smallest id it reaches."""
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if lo != hi:
        near &= chunk[:, None] != chunk[None, :]
    reach = np.arange(len(ids))  # rows are sorted by id
    while near.any():
        least = np.minimum(reach, np.where(near, reach[None, :], len(ids)).min(axis=1))
        if (least == reach).all():
            break
        reach = least
    for t in range(table):  # a pair counts in the first table where it meets
        if not near.any():
            break
        near &= cells[:, t][:, None] != cells[:, t][None, :]
    return near @ weight, ids[reach]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, width: float = 6.0, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row a row of ``vectors``.

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more, ``component_id`` is the smallest id that
    links reach, ``kept`` marks it. Vectors that are null, empty, all zero or hold a null or non-finite component link
    with nothing; so do vectors of different lengths with each other. Equal vectors are one node with a weight. Rows
    that repeat an id and vector link with each other. Null ids: linked like others, their component null unless a link has
    an id; never kept. Empty: no rows.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("__v"))
    sound = F.coalesce((F.size("__v") > 0) & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("__v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("__ok", sound).withColumn("__h1", F.when(F.col("__ok"), F.xxhash64("__v"))).withColumn("__h2", F.when(F.col("__ok"), F.xxhash64(F.lit(1), "__v")))
    classes = v.where("__ok").groupBy("__h1", "__h2").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("w"), F.first("__v").alias("v"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    nodes = materialize(classes, "vectors")
    n = nodes.count()
    k, n_tables = plan_tables(n, threshold, recall, width)
    cell = width * math.sqrt(2 - 2 * threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(k, n_tables, cell, seed)
        for b in batches:
            for _, rows, unit in unit_vectors(b.column(1)):
                for i in range(0, len(rows), 2048):
                    c = tables.cells(unit[i : i + 2048])
                    ids = b.column(0).to_numpy()[rows[i : i + 2048]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n_tables, dtype=np.int32), len(ids))), pa.array(c.ravel()), pa.array(np.repeat(ids, n_tables))], ["t", "cell", "id"])

    rows = nodes.select("id", "v").mapInArrow(hashed, "t int, cell bigint, id bigint")
    full = rows.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = rows.join(sized(full, n * n_tables), ["t", "cell"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("t", "cell", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"), "c", "id").join(sized(nodes.select("id", "w", "v"), n), "id")
    met = met.select("t", "cell", "lo", "hi", "id", "c", "w", "v").repartition("t", "cell", "lo", "hi").sortWithinPartitions("t", "cell", "lo", "hi", "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(k, n_tables, cell, seed)

        def block(part: pa.RecordBatch) -> pa.RecordBatch:
            t, lo, hi = (part.column(i)[0].as_py() for i in (0, 2, 3))
            ids, c, w = (part.column(i).to_numpy() for i in (4, 5, 6))
            links, reach = np.zeros(len(ids), dtype=np.int64), ids.copy()
            for _, at, unit in unit_vectors(part.column(7)):
                links[at], reach[at] = _compare(t, ids[at], w[at], unit, tables.cells(unit), c[at], lo, hi, threshold)
            some = (links > 0) | (reach != ids)
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, links, reach)], ["id", "links", "reach"])

        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), b.num_rows]
            if held and any(held[0].column(i)[0].as_py() != b.column(i)[0].as_py() for i in range(4)):
                yield block(whole())
                held = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(s, e - s))
                if e < b.num_rows:
                    yield block(whole())
                    held = []
        if held:
            yield block(whole())

    found = materialize(met.mapInArrow(compared, "id bigint, links bigint, reach bigint"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("reach").alias("b")))
    lowest = nodes.select("id", "lowest").join(sized(comps, n), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id"))
    least = lowest.groupBy("root").agg(F.min("lowest").alias("component_id"))
    told = lowest.join(sized(least, n), "root").join(sized(counts, n), "id", "left").select("id", "component_id", "links")
    told = nodes.select("id", F.col("__h1").alias("__k1"), F.col("__h2").alias("__k2"), "w").join(sized(told, n), "id")
    out = v.join(sized(told, n), (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")
    component = F.when(F.col("__k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("w") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
