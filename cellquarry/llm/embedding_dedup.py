"""Near-duplicate embeddings by small-world graphs of shards.

Equal vectors of a label are one vector with a weight.  The vectors of a label
are dealt by hash to shards of a bounded size, each with its own graph, and every
shard is queried by every shard of its label: by its own members, which start at
their own place, and by the members of each other shard.

Beams are widened, graph by graph, until an audit against brute force reaches the
target recall.  An audit has probes, members turned by an angle within the
threshold, so it always has true pairs; it has the nearest neighbours of sampled
members too, themselves left out, as far as these are pairs.  What each audit
found is kept with its graph (`audits`).  Beams cannot hold a crowd: a query whose
whole beam is within the threshold is compared with the whole shard, by blocks.

Cosine is verified in double precision.  A task returns a row per linked vector
(its links, its root among them), never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import components, drop_stored, stored
from .hnsw import BATCH, Graph

THRESHOLD = 0.93
#: Bytes of single-precision vectors in a shard: what a task holds, whatever the label's size.
SHARD_BYTES = 16 << 20
BEAM = 32
TARGET_RECALL = 0.995
#: Sampled members and turned members of each audit; one probe missed in so many is within the target.
AUDITED = 64
PROBES = 256
#: Slack for similarities in single precision before the verification.
SLACK = 1e-4
#: Rows of one block of exact comparisons.
BLOCK = 256
#: Tasks that shards and pairs of shards are dealt to, at most.
MOST_TASKS = 50_000

KEYS = ["label", "size", "shard"]


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def turned(vectors: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Each unit vector moved in a random direction to a cosine between the threshold and 1."""
    aside = rng.normal(size=vectors.shape)
    aside -= np.einsum("nd,nd->n", aside, vectors)[:, None] * vectors
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.where(length > 1e-6, aside / np.maximum(length, 1e-6), 0)
    cosine = rng.uniform(min(threshold + SLACK, 1), 1, (len(vectors), 1))
    return (cosine * vectors + np.sqrt(1 - cosine**2) * aside).astype(np.float32)


def audited_beam(graph: Graph, threshold: float, target: float = TARGET_RECALL, seed: int = 1) -> tuple[int, int, int]:
    """The beam at which searches find the target share of true pairs, and the pairs found and true there.

    Sampled members and probes must each reach the target; where a beam is full
    of pairs, the search goes on exactly and misses none.
    """
    size, rng = len(graph.vectors), np.random.default_rng(seed)
    members = rng.permutation(size)[:AUDITED]
    probes = turned(graph.vectors[rng.permutation(size)[:PROBES]], threshold, rng)
    own_truth = graph.vectors[members] @ graph.vectors.T >= threshold
    own_truth[np.arange(len(members)), members] = False
    truth = probes @ graph.vectors.T >= threshold
    beam = min(BEAM, size)
    while True:
        parts = []
        for want, search in ((own_truth, lambda: graph.around(members, beam)), (truth, lambda: graph.search(probes, beam))):
            ids, sims = search()
            hit = (sims >= threshold) & (ids >= 0)
            got = np.zeros(want.shape, bool)
            got[np.nonzero(hit)[0], ids[hit]] = True
            got |= hit.all(1)[:, None]
            parts.append((int((got & want).sum()), int(want.sum())))
        if beam >= size or all(found >= target * real for found, real in parts):
            return beam, sum(p[0] for p in parts), sum(p[1] for p in parts)
        beam = min(2 * beam, size)


def candidates(search, n: int, size: int, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member) pairs that beams of ``search`` find for n queries, and the queries whose beam is full of pairs.

    Where the beam holds the whole shard, every query is of the latter kind.
    """
    if beam >= size:
        none = np.zeros(0, np.int64)
        return none, none, np.arange(n)
    found_q, found_m, crowded = [], [], []
    for a in range(0, n, BATCH):
        at = np.arange(a, min(a + BATCH, n))
        ids, sims = search(at)
        hit = (sims >= threshold) & (ids >= 0)
        full = hit.all(1)
        q, c = np.nonzero(hit & ~full[:, None])
        found_q.append(at[q])
        found_m.append(ids[q, c])
        crowded.append(at[full])
    return np.concatenate(found_q), np.concatenate(found_m), np.concatenate(crowded)


class Links:
    """Weighted links and roots of the vectors of one task; ``ids`` in one row of numbers."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, threshold: float) -> None:
        self.ids, self.weights, self.threshold = ids, weights.astype(np.float64), threshold
        self.links, self.root = np.zeros(len(ids)), ids.copy()

    def pairs(self, u: np.ndarray, v: np.ndarray, left: np.ndarray, right: np.ndarray, shift: int) -> None:
        """Adds the real links among distinct pairs (u of ``left``, v of ``right``, which stands ``shift`` further in the row)."""
        real = np.zeros(len(u), bool)
        for a in range(0, len(u), 65536):
            s = slice(a, a + 65536)
            real[s] = np.einsum("nd,nd->n", left[u[s]], right[v[s]]) >= self.threshold
        u, v = u[real], v[real] + shift
        self.links += np.bincount(u, self.weights[v], len(self.ids)) + np.bincount(v, self.weights[u], len(self.ids))
        while len(u):
            low = np.minimum(self.root[u], self.root[v])
            new = self.root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            if (new == self.root).all():
                break
            self.root = new

    def crowd(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray, shift: int) -> None:
        """Adds all links of the queries ``rows`` of ``left`` to ``right``, by exact blocks.

        With ``shift`` 0 both sides are one shard: a query's link to itself does
        not count, and links among the queries are seen from both ends.
        """
        same = shift == 0
        inside = np.zeros(len(right), bool)
        if same:
            inside[rows] = True
        end = slice(shift, shift + len(right))
        for a in range(0, len(rows), BLOCK):
            at = rows[a : a + BLOCK]
            hit = left[at] @ right.T >= self.threshold
            if same:
                hit[np.arange(len(at)), at] = False
            self.links[at] += hit @ self.weights[end]
            back = self.weights[at] @ hit
            self.links[end] += np.where(inside, 0, back) if same else back
            for q, row in zip(at, hit, strict=True):
                near = np.flatnonzero(row) + shift
                if len(near):
                    roots = self.root[near]
                    low, high = min(roots.min(), self.root[q]), max(roots.max(), self.root[q])
                    if low != high:
                        self.root[np.isin(self.root, np.append(roots, self.root[q]))] = low

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = self.links > 0
        return self.ids[has], np.rint(self.links[has]).astype(np.int64), self.root[has]


def _build(threshold: float):
    """A shard's graph, its audit, and the links among its own members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids, weights = pdf["rep"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        vectors = units(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        graph, n = Graph(vectors), len(ids)
        beam, found, real = audited_beam(graph, threshold - SLACK)
        q, m, crowded = candidates(lambda at: graph.around(at, beam), n, n, beam, threshold - SLACK)
        apart = np.ones(n, bool)
        apart[crowded] = False
        plain = apart[q] & apart[m] & (q != m)
        pairs = np.unique(np.minimum(q, m)[plain] * n + np.maximum(q, m)[plain])
        links = Links(ids, weights, threshold)
        links.pairs(pairs // n, pairs % n, vectors, vectors, 0)
        links.crowd(crowded, vectors, vectors, 0)
        linked, counts, roots = links.rows()
        several = int(pdf["shards"].iloc[0]) > 1
        return pd.DataFrame(
            {
                "label": [pdf["label"].iloc[0]], "size": [vectors.shape[1]], "shard": [pdf["shard"].iloc[0]], "beam": [beam], "found": [found], "real": [real],
                "linked": [linked], "links": [counts], "roots": [roots], "ids": [ids if several else None], "weights": [weights if several else None],
                "vectors": [vectors.tobytes() if several else None], "graph": [graph.pack() if several else None],
            }
        )

    return run


def _compare(threshold: float):
    """Links between a shard and the members of another one, which query its graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                own, other = (np.asarray(row[f"ids_{s}"], np.int64) for s in "ab")
                graph_vectors, queries = (np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(-1, row["size"]) for s in "ab")
                graph = Graph.unpack(row["graph_a"], graph_vectors)
                single, beam = queries.astype(np.float32), row["beam_a"]
                q, m, crowded = candidates(lambda at: graph.search(single[at], beam), len(other), len(own), beam, threshold - SLACK)
                weights = np.concatenate([np.asarray(row[f"weights_{s}"], np.int64) for s in "ba"])
                links = Links(np.concatenate([other, own]), weights, threshold)
                links.pairs(q, m, queries, graph_vectors, len(other))
                links.crowd(crowded, queries, graph_vectors, len(other))
                linked, counts, roots = links.rows()
                yield pd.DataFrame({"rep": linked, "links": counts, "root": roots})

    return run


def _valid(rows: DataFrame) -> DataFrame:
    """Vectors that may link, with what tells equal ones."""
    whole = F.transform("embedding", lambda x: x + F.lit(0.0))  # one zero, not two
    valid = rows.where("fit").withColumn("embedding", whole)
    return valid.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding"), "size": F.size("embedding")})


def graphs(reps: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per shard of distinct vectors (``label``, ``size``, ``rep``, ``weight``, ``embedding``).

    It has the audit (``beam``, ``found`` of ``real`` pairs), the links inside
    (``linked``, ``links``, ``roots``) and, where the label has several shards,
    the graph and the vectors.
    """
    rows = F.greatest(F.floor(F.lit(shard_bytes) / (4 * F.col("size"))), F.lit(1))
    sizes = stored(reps.groupBy("label", "size").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / rows)), "labels")
    shards = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = reps.join(sizes.select("label", "size", "shards"), ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("rep"), "shards"))
    kinds = (
        "label string, size int, shard long, beam int, found long, real long, linked array<long>, links array<long>, roots array<long>, "
        "ids array<long>, weights array<long>, vectors binary, graph binary"
    )
    dealt = dealt.select(*KEYS, "shards", "rep", "weight", "embedding").repartition(min(max(4 * shards, 1), MOST_TASKS), *KEYS)
    return stored(dealt.groupBy(*KEYS).applyInPandas(_build(threshold), kinds), "graphs")


def audits(built: DataFrame) -> DataFrame:
    """What the audits of `graphs` found: ``label``, ``size``, ``shard``, ``beam``, ``recall`` (1 without true pairs)."""
    return built.select(*KEYS, "beam", F.coalesce(F.try_divide("found", "real"), F.lit(1.0)).alias("recall"))


def link_classes(embeddings: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Only vectors of equal, non-null label and equal length are compared.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a vec_id, link with nothing and are kept as their own
    component.  Repeated rows are vectors that link with each other.  An empty
    table gives an empty result.  Other columns are not read, whatever their
    names.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fit &= ~F.exists("embedding", infinite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    valid = _valid(rows)
    key = ["label", "size", "h1", "h2"]
    reps = stored(valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "vectors")
    built = graphs(reps, threshold, shard_bytes)
    inside = built.select(F.explode(F.arrays_zip("linked", "links", "roots")).alias("x")).select(F.col("x.linked").alias("rep"), F.col("x.links").alias("links"), F.col("x.roots").alias("root"))
    found = inside.unionByName(_across(built, threshold))
    found = stored(found, "links")
    comps = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.select(*key, "rep", "weight").join(links, "rep", "left").join(comps, "rep", "left").select(
        *key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = valid.select("vec_id", *key).join(per_rep, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop_stored(built)
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _across(built: DataFrame, threshold: float) -> DataFrame:
    """Links between the shards of a label, each pair of shards in one task."""
    several = built.where("graph is not null")
    names = several.select("label", "size", "shard")
    pairs = names.withColumnRenamed("shard", "shard_a").join(names.withColumnRenamed("shard", "shard_b"), ["label", "size"]).where("shard_a < shard_b")
    side = lambda s, *columns: several.select("label", "size", *[F.col(c).alias(f"{c}_{s}") for c in ("shard", "ids", "weights", "vectors", *columns)])
    tasks = pairs.join(side("a", "graph", "beam"), ["label", "size", "shard_a"]).join(side("b"), ["label", "size", "shard_b"])
    tasks = tasks.repartition(min(max(pairs.count(), 1), MOST_TASKS), "label", "size", "shard_a", "shard_b")
    return tasks.mapInPandas(_compare(threshold), "rep long, links long, root long")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.93 within its label."""
    return link_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
