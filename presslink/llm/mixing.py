"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

*Targets.* Sources share all words by weight; a source stops at ``max_epochs`` times its size and the excess
is shared again by weight until none is above.

*Quotas.* The rows of a source are hashed into blocks of about ``block_docs`` rows. A target of f whole
passes and a rest is f draws of every block, and in one more pass the blocks in order while they fit the
rest, then rows of one last block, largest that fit first. So the words taken miss the target by less
than the smallest rows of a block.

*Shards.* The draws of all sources are split over the output shards by a binary tree: at each node the left
half's draws per source are a multivariate hypergeometric sample of the node's, seeded by the node, so
each shard finds its exact quotas and the offsets before them alone, along its path from the root. A
shard's draws of a source are a slice of a pseudo-random permutation of that source's draws (a Feistel
network), so the shards' slices are disjoint and together complete. Rows of a shard are then put in hashed
order. Everything depends on the seed and the rows only, not on partitions: reruns agree.

The driver sees one row per source (at most ``MAX_SOURCES``, checked), never a row per document or block.

Defined cases: a null text has size 0 and rows of size 0 come and go with their block; a null source is
a source of its own, last in order; repeated rows are rows like any other and are drawn together; a null
doc_id hashes like a value of its own; an empty table gives no rows; other columns are kept by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslink.llm.common import store

WEIGHTS = (1, 2, 3)
MAX_SOURCES = 100_000
BLOCK_DOCS = 500
SHARD_BLOCKS = 16
SUPER = 1024


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], max_epochs: float = 3) -> list[float]:
    """Share the total by weight, each at most ``max_epochs`` times its size, the excess by weight again."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= max_epochs * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = share * weights[i]
            break
        for i in full:
            targets[i] = float(max_epochs * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


@dataclass(frozen=True)
class Mix:
    sources: DataFrame         # sid, source, source_size, target, blocks
    draws: DataFrame           # sid, block, pass, shard, part (only picked rows)
    picks: DataFrame           # sid, block, h
    shards: int
    seed: int


def _blocked(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Add sid, block and h to rows with ``id, source, size``."""
    s = F.broadcast(sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "blocks"))
    joined = rows.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    return (joined.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key), F.col("blocks")).cast("long"))
            .withColumn("h", F.xxhash64(F.lit(seed + 1), key, F.col("size"))))


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 11,
             block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """The plan for rows ``id, source, size``."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    blocks = [-(-r.n // block_docs) for r in found]
    schema = "sid int, source string, source_size long, target double, blocks long"
    sources = spark.createDataFrame([(i, r.source, r["size"], t, b) for i, (r, t, b) in enumerate(zip(found, targets, blocks))], schema)
    passes = [min(max_epochs, int(t / s + 1e-9)) if s else 0 for t, s in zip(targets, sizes)]
    rest = [max(0.0, t - p * s) for t, p, s in zip(targets, passes, sizes)]
    rests = spark.createDataFrame(list(enumerate(rest)), "sid int, rest double")

    blocked = store(_blocked(rows, sources, seed).select("sid", "block", "h", "size"), "mix-blocked")
    words = blocked.groupBy("sid", "block").agg(F.sum("size").alias("words")).withColumn("sup", F.floor(F.col("block") / SUPER))
    over = words.groupBy("sid", "sup").agg(F.sum("words").alias("all")).withColumn(
        "base", F.sum("all").over(Window.partitionBy("sid").orderBy("sup")) - F.col("all")).select("sid", "sup", "base")
    words = (words.join(over, ["sid", "sup"])
             .withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("sid", "sup").orderBy("block"))))
    inside = words.join(F.broadcast(rests), "sid")
    fit = F.col("upto") <= F.col("rest")
    cut = {r.sid: r for r in inside.groupBy("sid").agg(
        F.max(F.when(fit, F.col("block"))).alias("last"), F.max(F.when(fit, F.col("upto"))).alias("upto")).collect()}
    whole, left = [], []                       # blocks of the last pass that are drawn whole, words after them
    for i in range(len(found)):
        r = cut.get(i)
        whole.append(0 if not rest[i] or r is None or r.last is None else r.last + 1)
        left.append(0.0 if not rest[i] else rest[i] - (r.upto if whole[i] else 0))

    part = spark.createDataFrame([(i, whole[i], float(left[i])) for i in range(len(found)) if left[i] > 0 and whole[i] < blocks[i]],
                                 "sid int, block long, left double")
    of_part = blocked.join(F.broadcast(part), ["sid", "block"]).groupBy("sid", "block", "h", "left").agg(F.sum("size").alias("size"))
    picks = of_part.groupBy("sid").applyInArrow(_pick, "sid int, block long, h long")
    has_part = {i for i in range(len(found)) if left[i] > 0 and whole[i] < blocks[i]}
    draws = [passes[i] * blocks[i] + whole[i] + (i in has_part) for i in range(len(found))]
    shards = max(1, -(-sum(draws) // shard_blocks))
    return Mix(sources, _draws(spark, draws, blocks, passes, whole, seed, shards), store(picks, "mix-picks"), shards, seed)


def _pick(table):
    """Rows of the last block for the words left: largest first, each if it still fits."""
    order = table.sort_by([("size", "descending"), ("h", "ascending")])
    left, keep = order.column("left")[0].as_py(), []
    for i, size in enumerate(order.column("size").to_pylist()):
        if 0 < size <= left:
            keep.append(i)
            left -= size
    return order.take(pa.array(keep, pa.int64())).select(["sid", "block", "h"])


# -- the splitting tree ---------------------------------------------------------------------------

def shard_quotas(shard: int, shards: int, draws: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws per source of a shard, and those of all shards before it."""
    lo, hi, here, before = 0, shards, draws.copy(), np.zeros_like(draws)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = int(here.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(here, take, method="marginals")
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return here, before


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudo-random permutation of 0 .. n - 1: four Feistel rounds, walking on until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    salts = np.random.default_rng([key, n]).integers(1, 1 << 62, 4, dtype=np.uint64)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        a, b = out[todo] >> np.uint64(half), out[todo] & mask
        for s in salts:
            f = (b + s) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def _draws(spark, draws, blocks, passes, whole, seed, shards) -> DataFrame:
    counts = np.array(draws, dtype=np.int64)
    source_blocks, source_passes, source_whole = np.array(blocks), np.array(passes), np.array(whole)

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                own, before = shard_quotas(shard, shards, counts, seed)
                for sid in np.flatnonzero(own).tolist():
                    at = permuted(np.arange(before[sid], before[sid] + own[sid]), int(counts[sid]), seed + sid)
                    n = len(at)
                    turn, block = at // source_blocks[sid], at % source_blocks[sid]
                    part = (turn == source_passes[sid]) & (block == source_whole[sid])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, sid, np.int32)), pa.array(block), pa.array(turn.astype(np.int32)),
                         pa.array(np.full(n, shard, np.int64)), pa.array(part)], names=["sid", "block", "turn", "shard", "part"])

    ids = spark.range(0, shards if counts.sum() else 0, 1, min(shards, 200))
    return store(ids.mapInArrow(run, "sid int, block long, turn int, shard long, part boolean"), "mix-draws")


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, keep: bool = False) -> DataFrame:
    new = [F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")]
    return docs.select(*([F.struct("*").alias("_row")] if keep else []), *new)


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``id, size, source_size, target, taken, copies`` per row: the words that the mix takes of it."""
    rows = store(_rows(docs, id_col, source_col, text_col), "mix-rows")
    mix = plan_mix(rows, **how)
    times = mix.draws.where("NOT part").groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = (_blocked(rows, mix.sources, mix.seed).join(times, ["sid", "block"], "left")
              .join(mix.picks.withColumn("picked", F.lit(1)), ["sid", "block", "h"], "left"))
    copies = F.coalesce("times", F.lit(0)) + F.coalesce("picked", F.lit(0))
    return placed.select("id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: rows of ``docs`` once per copy, dealt to shards and in shuffled order inside them."""
    plan = plan_mix(store(_rows(docs, id_col, source_col, text_col), "mix-rows"), **how)
    rows = _blocked(_rows(docs, id_col, source_col, text_col, keep=True), plan.sources, plan.seed)
    drawn = (rows.join(plan.draws, ["sid", "block"])
             .join(plan.picks.withColumn("picked", F.lit(True)), ["sid", "block", "h"], "left")
             .where("NOT part OR picked"))
    shuffled = (drawn.withColumn("_order", F.xxhash64(F.lit(plan.seed + 2), "shard", "turn", "h", "id"))
                .repartition(min(plan.shards, 20_000), "shard").sortWithinPartitions("shard", "_order"))
    return shuffled.select("_row.*")
