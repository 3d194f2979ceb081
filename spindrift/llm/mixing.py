"""Mixing sources to target weights, native.

Each source's words, its documents laid end to end, are packed into blocks of ``block_words``. Every output slot draws
a source, which gives each shard multinomial counts; draws past a source's quota are settled on sources short of
theirs. The j-th draw of a source maps through the source's own pseudorandom permutation of block indices (a new one
each pass over its blocks), and blocks are joined by index.

No group grows with the input: documents are summed by (source, hash bucket) with as many buckets as rows need, slots
are ranked within shards of fixed size, and windows over a source only see one row a bucket or shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

ROUNDS = 20


@dataclass
class Mix:
    docs: DataFrame  #: __id, __th, source, size, sidx, at (words before it in its source)
    sources: DataFrame  #: source, source_size, sidx, weight, target, n_blocks, quota
    slots: DataFrame  #: slot, shard, sidx, pass, block
    pieces: DataFrame  #: sidx, block, __id, __th, first (of its words), n (words)


def swap_or_not(df: DataFrame, x: str, n: str, key: str) -> DataFrame:
    """``df`` with x, one of 0..n-1, moved by a pseudorandom permutation of these for any n >= 1: the swap-or-not shuffle.

    A round pairs each value with another and swaps both or neither by a hash of the pair, so no walk is needed to stay
    in range. Rounds are projections one above the other, which generated code runs at a few nanoseconds each.
    """
    for r in range(ROUNDS):
        df = df.withColumn("__k", F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.col(n)))
        df = df.withColumn("__o", F.when(F.col("__k") >= F.col(x), F.col("__k") - F.col(x)).otherwise(F.col("__k") - F.col(x) + F.col(n)))
        swap = F.xxhash64(F.col(key), F.lit(r), F.greatest(F.col(x), F.col("__o"))).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(x, F.when(swap, F.col("__o")).otherwise(F.col(x))).drop("__k", "__o")
    return df


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``sidx``, ``weight`` and ``target`` to a table of sources (``source``, ``source_size``), one row each.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times the sum of all sizes by weight;
    targets stop at ``cap`` times the size, the excess is reshared by weight until none is above. That fixed point is
    min(cap * size, L * weight): with sources by cap * size / weight ascending, L is what is left over the weights left,
    at the first source that it does not fill. One row a source passes the windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = (
        sizes.withColumn("sidx", F.row_number().over(by_name).cast("bigint") - 1)
        .withColumn("weight", F.element_at(table, (F.col("sidx") % len(weights)).cast("int") + 1))
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__ratio", F.col("__cap") / F.col("weight"))
    )
    order = Window.orderBy("__ratio", "sidx")
    everything = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__before", F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__left"))
        .withColumn("__l", F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(everything))
    )
    target = F.when(F.col("__l").isNull() | (F.col("__ratio") <= F.col("__l")), F.col("__cap")).otherwise(F.col("__l") * F.col("weight"))
    return s.select("source", "source_size", "sidx", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    block_words: int = 64,
    shard_slots: int = 65_536,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """The mix of ``docs`` whose sources take words near their targets (``targets``), none over ``cap`` times its own.

    Null or empty texts have no words and are never taken; a null source is a source of its own, last in order. Rows
    that repeat id and text are one document (of the smallest source named). Null ids are documents like any other.
    Empty table: empty parts. The same rows, in any order and partitioning, give the same mix.
    """
    spark = docs.sparkSession
    L = block_words
    sized = materialize(
        docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("bigint").alias("size"))
        .groupBy("__id", "__th")
        .agg(F.min("source").alias("source"), F.max("size").alias("size")),
        "mix-sizes",
    )
    buckets = max(64, math.ceil(sized.count() / 50_000))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / L).cast("bigint")).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(F.col("n_blocks") * cap, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    )
    sources = materialize(sources, "mix-sources")

    # where each document starts among its source's words
    named = sized.join(sources.select(F.col("source").alias("__s"), "sidx"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    named = named.withColumn("__b", F.pmod(F.xxhash64("__id", "__th"), F.lit(buckets)))
    sums = named.groupBy("sidx", "__b").agg(F.sum("size").alias("__n"))
    before = sums.select("sidx", "__b", (F.sum("__n").over(Window.partitionBy("sidx").orderBy("__b")) - F.col("__n")).alias("__start"))
    inside = Window.partitionBy("sidx", "__b").orderBy("__id", "__th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        named.withColumn("__in", F.sum("size").over(inside) - F.col("size"))
        .join(before, ["sidx", "__b"])
        .select("__id", "__th", "source", "size", "sidx", (F.col("__start") + F.col("__in")).alias("at"))
    )
    pieces = (
        placed.where(F.col("size") > 0)
        .select("sidx", "__id", "__th", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / L), F.floor((F.col("at") + F.col("size") - 1) / L))).alias("block"))
        .withColumn("first", F.greatest(F.lit(0).cast("bigint"), F.col("block") * L - F.col("at")))
        .withColumn("n", F.least(F.col("size"), (F.col("block") + 1) * L - F.col("at")) - F.col("first"))
        .select("sidx", "block", "__id", "__th", "first", "n")
    )
    return Mix(placed, sources, _draw(spark, sources, shard_slots, seed), pieces)


def _draw(spark, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    total, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    n = max(1, total)
    by_idx = Window.orderBy("sidx")  # one row a source
    spans = sources.where("quota > 0").select("sidx", "quota", "n_blocks", (F.sum("quota").over(by_idx) - F.col("quota")).alias("lo"), F.sum("quota").over(by_idx).alias("hi"))
    # a point of 0..n-1 finds its source's span through chunks of 0..n-1, so that it is an equi-join for any number of sources
    width = math.ceil(n / max(1024, 4 * n_sources))
    chunks = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("chunk"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("__p"))
    drawn = (
        slots.withColumn("chunk", F.floor(F.col("__p") / width))
        .join(chunks, "chunk")
        .where((F.col("__p") >= F.col("lo")) & (F.col("__p") < F.col("hi")))
        .select("slot", "shard", "sidx", "quota", "n_blocks")
    )
    drawn = materialize(drawn, "mix-draws")
    counts = drawn.groupBy("sidx", "shard").agg(F.count("*").alias("__n"))  # the shard's multinomial counts
    earlier = counts.select("sidx", "shard", (F.sum("__n").over(Window.partitionBy("sidx").orderBy("shard")) - F.col("__n")).alias("__earlier"))
    ranked = (
        drawn.withColumn("__in", F.row_number().over(Window.partitionBy("sidx", "shard").orderBy("slot")) - 1)
        .join(earlier, ["sidx", "shard"])
        .withColumn("j", F.col("__earlier") + F.col("__in"))
        .select("slot", "shard", "sidx", "quota", "n_blocks", "j")
    )
    # slots past a source's quota, numbered in order, go to the sources short of theirs
    over = ranked.where("j >= quota").select("slot", "shard")
    per_shard = over.groupBy("shard").agg(F.count("*").alias("__n"))
    over_before = per_shard.select("shard", (F.sum("__n").over(Window.orderBy("shard")) - F.col("__n")).alias("__earlier"))
    numbered = (
        over.withColumn("__in", F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1)
        .join(over_before, "shard")
        .select("slot", "shard", (F.col("__earlier") + F.col("__in")).alias("__f"))
    )
    got = counts.groupBy("sidx").agg(F.sum("__n").alias("__got"))
    short = spans.join(got, "sidx", "left").select("sidx", "n_blocks", F.coalesce("__got", F.lit(0)).alias("__got"), (F.col("quota") - F.coalesce("__got", F.lit(0))).alias("__short")).where("__short > 0")
    short = short.withColumn("__lo", F.sum("__short").over(by_idx) - F.col("__short"))
    wanted = short.select("sidx", "n_blocks", "__got", "__lo", F.explode(F.sequence(F.col("__lo"), F.col("__lo") + F.col("__short") - 1)).alias("__f"))
    settled = numbered.join(wanted, "__f").select("slot", "shard", "sidx", "n_blocks", (F.col("__got") + F.col("__f") - F.col("__lo")).alias("j"))
    every = ranked.where("j < quota").select("slot", "shard", "sidx", "n_blocks", "j").unionByName(settled)
    turn = F.floor(F.col("j") / F.col("n_blocks"))
    key = F.xxhash64(F.lit(seed), F.col("sidx"), turn)
    dealt = every.select("slot", "shard", "sidx", "n_blocks", turn.alias("pass"), (F.col("j") % F.col("n_blocks")).alias("block"), key.alias("__key"))
    # written before the permutation and after it, as a plan with all its rounds above these joins is slow to optimise
    dealt = materialize(dealt, "mix-dealt")
    moved = swap_or_not(dealt, "block", "n_blocks", "__key").select("slot", "shard", "sidx", "pass", "block")
    return materialize(moved, "mix-slots")


def words_taken(mix: Mix) -> DataFrame:
    """``__id, __th, taken``: the words the mix takes of each document, repeats counted; only documents it takes."""
    times = mix.slots.groupBy("sidx", "block").agg(F.count("*").alias("__times"))
    return mix.pieces.join(times, ["sidx", "block"]).groupBy("__id", "__th").agg(F.sum(F.col("n") * F.col("__times")).alias("taken"))


def mixed_blocks(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: ``slot, shard, source, pass, block, text``, a block's words with one space between them."""
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).withColumn("__h", F.xxhash64(F.coalesce("__t", F.lit("")))).dropDuplicates(["__i", "__h"])
    cut = mix.pieces.join(texts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__h")))
    cut = cut.select("sidx", "block", "__id", "__th", F.array_join(F.slice(words(F.col("__t")), F.col("first").cast("int") + 1, F.col("n").cast("int")), " ").alias("__w"), (F.col("first") > 0).alias("__later"))
    # a block holds block_words pieces at most; one that goes on a document started before comes first, then bucket order
    at = mix.docs.select(F.col("__id").alias("__i2"), F.col("__th").alias("__h2"), "at")
    cut = cut.join(at, F.col("__id").eqNullSafe(F.col("__i2")) & (F.col("__th") == F.col("__h2")))
    blocks = cut.groupBy("sidx", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "__w"))), lambda p: p["__w"]), " ").alias("text"))
    return mix.slots.join(blocks, ["sidx", "block"]).join(mix.sources.select("sidx", "source"), "sidx").select("slot", "shard", "source", "pass", "block", "text")


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' columns, one row for each document and pass that the mix takes it in, its text cut to the words taken.

    A document taken whole keeps its text as it is; else the words taken are joined by one space.
    """
    spans = (
        mix.pieces.join(mix.slots.select("sidx", "block", F.col("pass").alias("__pass")), ["sidx", "block"])
        .groupBy("__id", "__th", "__pass")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n")))).alias("__spans"), F.sum("n").alias("__n"))
    )
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (th == F.col("__th")))
    w = words(F.col(text_col))
    bound = F.array(F.struct(w.alias("w"), F.col("__spans").alias("s")))
    cut = F.array_join(F.element_at(F.transform(bound, lambda b: F.flatten(F.transform(b["s"], lambda p: F.slice(b["w"], p["first"] + 1, p["n"])))), 1), " ")
    text = F.when(F.size(w) == F.col("__n"), F.col(text_col)).otherwise(cut)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mix_sources(docs)
    taken = words_taken(mix).select(F.col("__id").alias("__i"), F.col("__th").alias("__h"), "taken")
    out = mix.docs.join(taken, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__h")), "left")
    out = out.join(mix.sources.select("sidx", "source_size", "target"), "sidx")
    return out.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
