"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share all words by weight; a target stops at ``MOST_REPEATS`` times its
source's words and the rest is shared again.  The documents of a source are
dealt by hash to shards of about ``SHARD_WORDS`` words and ``SHARD_ROWS`` rows at
most, so a source that holds a third of all rows, or only blank ones, has more
shards, not a larger one.  Inside a shard, documents lie in seeded order on a
circle of words that is cut into blocks of equal size.  The blocks of the mix are
apportioned by highest quotients (divisors 1, 3, 5, ...), first to the sources,
with their targets as votes, then each source's to its shards, with their blocks
as votes.  A shard takes all its blocks as often as its quota allows, and the rest
of the quota from a seeded block onwards; as the documents' order is random,
these are a random choice that cuts two documents at most.  A document is taken
as often as chosen blocks cover its words, at most the most repeats.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import carried, restored, stored

SEED = 20240229
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Words of a block, and of a shard of a source.
BLOCK_WORDS = 16
SHARD_WORDS = 262_144
SHARD_ROWS = 65_536
#: Rows of about 50 bytes up to which a driver-made table is broadcast.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares the sum of sizes by weight; none above ``most`` times its size."""
    targets = [0.0] * len(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2a + 1); ties go to the first.

    Rounding votes by a common divisor comes within a seat or so for each party;
    a heap of quotients gives or takes the rest, so the cost does not grow with
    the number of seats.  ``most`` bounds the seats of each party.
    """
    votes = np.asarray(votes, np.float64)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or not (votes > 0).any():
        return out
    limit = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, limit[votes > 0].sum() if most is not None else seats))
    out = np.minimum(np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64), limit)
    have = int(out.sum())
    if have > seats:  # take back the lowest quotients that were served
        heap = [(votes[i] / (2 * out[i] - 1), -i) for i in range(len(votes)) if out[i]]
        heapq.heapify(heap)
        for _ in range(have - seats):
            i = -heap[0][1]
            out[i] -= 1
            if out[i]:
                heapq.heapreplace(heap, (votes[i] / (2 * out[i] - 1), -i))
            else:
                heapq.heappop(heap)
    elif have < seats:
        heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and out[i] < limit[i]]
        heapq.heapify(heap)
        for _ in range(seats - have):
            i = heap[0][1]
            out[i] += 1
            if out[i] < limit[i]:
                heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
            else:
                heapq.heappop(heap)
    return out


def source_targets(sizes: dict[str | None, int]) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in code point order, null last."""
    rows = list(sizes.items())
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))  # Python compares strings by code point
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    return [(s, n, t) for (s, n), t in zip(rows, share_targets([n for _, n in rows], weights), strict=True)]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks a driver-made table for broadcast if its rows are few; else Spark joins as it finds best."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def quotas(targets: dict[str | None, tuple[int, float]], shards: list[tuple[str | None, int, int]], block_words: int) -> list[tuple[int, int]]:
    """(blocks, quota of blocks) of each shard (source, number, words): sources are served first, then shards within each.

    ``targets`` has each source's words and target.  A shard takes each of its
    blocks `MOST_REPEATS` times at most, a source its shards' blocks as often.
    """
    blocks = np.array([max(1, round(n / block_words)) for *_, n in shards], np.int64)
    members: dict[str | None, list[int]] = {}
    for i, (source, *_) in enumerate(shards):
        members.setdefault(source, []).append(i)
    own = [blocks[at] for at in members.values()]
    votes = np.array([targets[s][1] / targets[s][0] * b.sum() for s, b in zip(members, own, strict=True)])
    of_source = sainte_lague(votes, round(float(votes.sum())), MOST_REPEATS * np.array([b.sum() for b in own], np.int64)) if len(own) else []
    out = np.zeros(len(shards), np.int64)
    for at, b, seats in zip(members.values(), own, of_source, strict=True):
        out[at] = sainte_lague(b.astype(np.float64), int(seats), MOST_REPEATS * b)
    return [(int(b), int(q)) for b, q in zip(blocks, out, strict=True)]


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``size``, ``source_size``, ``target`` and ``taken`` of every document.

    Null texts and texts without a word have size 0 and are never taken; a null
    source is a source of its own.  Very long texts are counted whole and may be
    cut by a block's edge.  Rows equal in id and text lie side by side on the
    line and may be taken unequally often; their sum is the same in every run.
    Empty tables give an empty result.  Other columns are not read.  A row per
    source and one per shard (`SHARD_WORDS` words) reach the driver.
    """
    spark = docs.sparkSession
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sizes = stored(sizes, "sizes")
    per_source = {r["source"]: (int(r["source_size"]), r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()}
    rows = source_targets({s: n for s, (n, _) in per_source.items()})
    plan = spark.createDataFrame(
        [(s, n, t, max(1, math.ceil(n / shard_words), math.ceil(per_source[s][1] / shard_rows))) for s, n, t in rows], "source string, source_size long, target double, shards long"
    )
    placed = sizes.alias("d").join(bounded(plan, len(rows)).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left")
    placed = placed.select("d.*", "source_size", "target", "shards").withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("place"), "shards"))
    shards = [(r["source"], r["shard"], int(r["n"])) for r in placed.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()]
    shards.sort(key=lambda r: (r[0] is None, r[0] or "", r[1]))
    seats = quotas({s: (n, t) for s, n, t in rows}, shards, block_words)
    served = spark.createDataFrame(
        [(s, sh, n, b, q) for (s, sh, n), (b, q) in zip(shards, seats, strict=True)], "source string, shard long, shard_size long, blocks long, quota long"
    )
    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    drawn = placed.alias("d").join(
        bounded(served, len(shards)).alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")), "left"
    )
    drawn = drawn.select("d.*", "shard_size", "blocks", "quota").withColumn("end", F.col("begin") + F.col("size"))
    rest, turn = F.col("quota") % F.col("blocks"), F.pmod(F.xxhash64("source", "shard", F.lit(seed)), "blocks")
    at_block = lambda b: F.floor(b.cast("decimal(20,0)") * F.col("shard_size") / F.col("blocks")).cast("long")
    within = lambda a, b: F.greatest(F.least(F.col("end"), at_block(b)) - F.greatest(F.col("begin"), at_block(a)), F.lit(0).cast("long"))
    partly = within(turn, F.least(turn + rest, F.col("blocks"))) + within(F.lit(0).cast("long"), F.greatest(turn + rest - F.col("blocks"), F.lit(0)))
    whole = F.expr("quota div blocks") * F.col("size")
    taken = F.when((F.col("size") > 0) & (F.col("quota") > 0), whole + partly).otherwise(F.lit(0).cast("long"))
    return drawn.select("doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).drop("text_hash")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with ``mix_size``, ``mix_target`` and ``mix_taken``."""
    taken = stored(mix(docs), "mix")
    keys = ["doc_id", "text_hash"]
    names = docs.columns
    left = docs.select(*carried(names), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.lit(1).alias("row"))
    taken = taken.withColumn("row", F.lit(1))
    if not taken.groupBy(*keys).count().where("count > 1").isEmpty():
        left = left.withColumn("row", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64(*[F.to_json(F.struct(f"_p{i}")) for i in range(len(names))]))))
        taken = taken.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("taken")))
    same = F.col("d.id").eqNullSafe(F.col("m.doc_id")) & F.col("d.hash").eqNullSafe(F.col("m.text_hash")) & (F.col("d.row") == F.col("m.row"))
    joined = left.alias("d").join(taken.where("taken > 0").alias("m"), same)
    joined = joined.select(*[f"_p{i}" for i in range(len(names))], F.col("m.size").alias("mix_size"), F.col("m.target").alias("mix_target"), F.col("m.taken").alias("mix_taken"))
    return restored(joined, names, ("mix_size", "mix_target", "mix_taken"))
