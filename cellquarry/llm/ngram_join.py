"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is the set of its runs of ``width`` words.  Every distinct set has a
label in each of ``trees`` trees: ``depth`` MinHash values, packed from the first
in the highest bits, so that the order of the labels is the order of the tree's
prefix trie and a prefix is a run of neighbours in it.  Two sets meet in a tree
where their labels agree in a prefix.

Labels are made once.  An audit then finds how long the matched prefix may be:
starting at the whole label, it is shortened until the share of true pairs that
meet reaches the target.  True pairs are of two kinds, and each must reach it:
all links between a bounded sample of the sets and all documents, found exactly by
comparing shingles in the pass that makes the labels; and probes, copies of sampled
sets changed down to the threshold itself, so that no audit is without pairs.

Verification is exact on the sets of 64-bit hashes and never makes a row for a
pair.  A set's home is the largest trie node among its own nodes and those its
neighbours in them have; homes are divided by hash into blocks of about
``block`` sets; only pairs of blocks that share a trie node are compared, each pair of sets in one place alone, by products of incidence
matrices.  A comparison returns a row per set: its links and its root in a
forest of the links found there.  Equal sets were one row before all this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import annotate, carried, components, drop_stored, restored, stored
from .textkit import U64, mix, shingle_hashes, word_batches

WIDTH = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6
#: Bits of each MinHash value in a label; depth times bits must fit 64.
VALUE_BITS = 10
#: Share of true pairs that must meet in some tree, over links of sampled sets and over probes at the threshold.
TARGET_RECALL = 0.9997
#: Sampled texts of the audit and probes made of each.
AUDITED = 256
PROBES = 64
BLOCK = 256

SEED = 20250705


def _multipliers(trees: int, depth: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, size=(trees, depth), dtype=np.uint64) * U64(2) + U64(1)


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sub-batches: index of the first text, distinct shingle hashes of all its texts, offsets."""
    for words in word_batches(texts):
        shingles, offset = shingle_hashes(words.hashes(), words.offset, width)
        parts = [np.unique(shingles[a:b]) for a, b in zip(offset[:-1], offset[1:], strict=True)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield words.first, flat, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def labels_of(flat: np.ndarray, offset: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Packed labels (set, tree) of the non-empty sets that ``offset`` cuts ``flat`` into."""
    factors, at = _multipliers(trees, depth), offset[:-1]
    out = np.zeros((len(at), trees), np.uint64)
    for t in range(trees):
        for d in range(depth):
            low = mix(np.minimum.reduceat(flat * factors[t, d], at)) & U64((1 << VALUE_BITS) - 1)
            out[:, t] |= low << U64(VALUE_BITS * (depth - 1 - d))
    return out


def common_prefix(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The longest prefix, in values, that labels share in any tree (the last axis)."""
    differ = a ^ b
    out = np.zeros(differ.shape[:-1], np.int64)
    for p in range(1, depth + 1):
        out[(differ >> U64(VALUE_BITS * (depth - p)) == 0).any(-1)] = p
    return out


def prefix_of(label, depth: int, prefix: int):
    """The column of a label's first ``prefix`` values."""
    return F.shiftrightunsigned(label, VALUE_BITS * (depth - prefix))


@dataclass
class Sample:
    """Sampled sets: their shingles in order with the sets that hold each, sizes and labels."""

    shingles: np.ndarray
    first: np.ndarray  # of each shingle among ``owner``, and one more at the end
    owner: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray


def sample_sets(texts: list[str], width: int, trees: int, depth: int) -> tuple[Sample, list[np.ndarray]]:
    """The sample of the audit from distinct texts, and its sets."""
    sets = [flat[a:b] for _, flat, offset in _sets(texts, width) for a, b in zip(offset[:-1], offset[1:], strict=True) if b > a]
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    labels = labels_of(flat, np.concatenate([[0], np.cumsum(sizes)]), trees, depth) if sets else np.zeros((0, trees), np.uint64)
    order = np.argsort(flat, kind="stable")
    shingles, first = np.unique(flat[order], return_index=True)
    return Sample(shingles, np.append(first, len(flat)), np.repeat(np.arange(len(sets)), sizes)[order], sizes, labels), sets


def probe_prefixes(sets: list[np.ndarray], labels: np.ndarray, threshold: float, trees: int, depth: int, seed: int = SEED) -> np.ndarray:
    """For copies of each set that are just at the threshold, the longest prefix shared with it."""
    rng, factors, out = np.random.default_rng(seed), _multipliers(trees, depth), []
    for own, label in zip(sets, labels, strict=True):
        n = len(own)
        kept = int(np.ceil(2 * threshold * n / (1 + threshold) - 1e-9))  # kept / (2n - kept) >= threshold
        stay = np.argsort(rng.random((PROBES, n)), axis=1) < kept
        copies = np.where(stay, own, rng.integers(0, 2**64, size=(PROBES, n), dtype=np.uint64))
        probe = np.zeros((PROBES, trees), np.uint64)
        for t in range(trees):
            for d in range(depth):
                probe[:, t] |= (mix((copies * factors[t, d]).min(1)) & U64((1 << VALUE_BITS) - 1)) << U64(VALUE_BITS * (depth - 1 - d))
        out.append(common_prefix(probe, label[None, :], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def choose_prefix(kinds: list[dict[int, int]], depth: int, target: float) -> tuple[int, float]:
    """The longest prefix at which each kind of true pairs (how many share a prefix of each length) meets as often as wanted, and the least share that does."""
    share = lambda met, p: sum(n for shared, n in met.items() if shared >= p) / (sum(met.values()) or 1) if met else 1.0
    for prefix in range(depth, 0, -1):
        recall = min((share(met, prefix) for met in kinds), default=1.0)
        if recall >= target:
            break
    return prefix, recall


#: Shared shingles that the audit counts at once.
COUNTED_AT_ONCE = 250_000


def audit_links(sample: Sample, flat: np.ndarray, offset: np.ndarray, labels: np.ndarray, threshold: float, depth: int) -> list[list[int]]:
    """For each set, the longest prefix shared with each sampled set that it truly links with (equal ones left out)."""
    n, sizes = len(offset) - 1, np.diff(offset)
    out: list[list[int]] = [[] for _ in range(n)]
    if not len(sample.shingles):
        return out
    at = np.minimum(np.searchsorted(sample.shingles, flat), len(sample.shingles) - 1)
    hit = np.flatnonzero(sample.shingles[at] == flat)
    doc, at = np.searchsorted(offset, hit, "right") - 1, at[hit]
    owners = sample.first[at + 1] - sample.first[at]
    load = np.concatenate([[0], np.cumsum(np.bincount(doc, owners, n))])  # entries before each document
    begin = 0
    while begin < n:  # as many whole documents as keep the counted entries few
        stop = max(int(np.searchsorted(load, load[begin] + COUNTED_AT_ONCE, "right")) - 1, begin + 1)
        part = slice(*np.searchsorted(doc, [begin, stop]))
        each = owners[part]
        row = np.repeat(sample.first[at[part]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        key, both = np.unique(np.repeat(doc[part], each) * len(sample.sizes) + sample.owner[row], return_counts=True)
        d, q = key // len(sample.sizes), key % len(sample.sizes)
        union = sizes[d] + sample.sizes[q] - both
        link = (both / union >= threshold) & (both < union)
        for i, p in zip(d[link], common_prefix(labels[d[link]], sample.labels[q[link]], depth), strict=True):
            out[i].append(int(p))
        begin = stop
    return out


def _features(width: int, threshold: float, trees: int, depth: int, sample: Sample):
    def judge(texts: list[str | None]) -> Iterator[tuple]:
        for first, flat, offset in _sets(texts, width):
            n = len(offset) - 1
            sizes = np.diff(offset)
            full = np.flatnonzero(sizes)
            labels = np.zeros((n, trees), np.uint64)
            high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            met: list[list[int]] = [[] for _ in range(n)]
            if len(full):
                at = offset[:-1][full]
                high[full] = np.add.reduceat(mix(flat ^ U64(SEED)), at)
                low[full] = np.add.reduceat(mix(flat + U64(SEED)), at)
                labels[full] = labels_of(flat, np.append(at, len(flat)), trees, depth)
                met = audit_links(sample, flat, offset, labels, threshold, depth)
            yield first, high.view(np.int64), low.view(np.int64), sizes, list(labels.view(np.int64)), met

    return judge


def _shingles(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, flat, offset in _sets(pdf["text"].tolist(), width):
                n = len(offset) - 1
                yield pd.DataFrame(
                    {
                        "set_id": pdf["set_id"].iloc[first : first + n].to_numpy(),
                        "weight": pdf["weight"].iloc[first : first + n].to_numpy(),
                        "shingles": [flat[a:b].view(np.int64) for a, b in zip(offset[:-1], offset[1:], strict=True)],
                    }
                )

    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by incidence matrices of bounded width."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets) if n else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    shared = np.bincount(group)[group] > 1 if len(values) else fresh
    group, owner = group[shared], owner[shared]
    group = np.unique(group, return_inverse=True)[1] if len(group) else group
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(group[-1]) + 1 if len(group) else 0, columns):
        lo, hi = np.searchsorted(group, [a, a + columns])
        m = np.zeros((n, min(columns, int(group[-1]) + 1 - a)), np.float32)
        m[owner[lo:hi], group[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _compare(ids, sides, weights, sets, threshold: float) -> pd.DataFrame:
    """Links within one task: all pairs of a block, or those between two blocks."""
    sizes = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    union = sizes[:, None] + sizes[None, :] - both
    similarity = both / np.maximum(union, 1)
    linked = similarity >= threshold
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    links = linked @ weights
    root = ids.copy()
    while True:  # the smallest id over the links, until nothing changes
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == root).all():
            break
        root = new
    has = linked.any(1)
    return pd.DataFrame({"set_id": ids[has], "links": links[has].astype(np.int64), "root": root[has]})


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            return _compare(
                pdf["set_id"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64), pdf["weight"].to_numpy(np.float64), list(pdf["shingles"]), threshold
            )

        for pdf in batches:
            task = pdf["task"].to_numpy()
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            for part in (pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True) if b > a):
                if held and held[-1]["task"].iloc[0] != part["task"].iloc[0]:
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    return run


def _sampled(docs: DataFrame, width: int, trees: int, depth: int) -> tuple[Sample, list[np.ndarray]]:
    """The audit's sample: of the distinct texts those of the lowest seeded hashes."""
    lowest = docs.where("text is not null").groupBy("text_hash").count().orderBy(F.xxhash64("text_hash", F.lit(SEED)), "text_hash").limit(AUDITED).select("text_hash")
    rows = docs.join(F.broadcast(lowest), "text_hash").select("text_hash", "text").dropDuplicates(["text_hash"]).orderBy("text_hash").collect()
    return sample_sets([r["text"] for r in rows], width, trees, depth)


def forest(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target_recall: float = TARGET_RECALL) -> tuple[DataFrame, int, float]:
    """Labels of all documents (``doc``, ``text``, ``text_hash`` given), the prefix to match and the recall measured there."""
    sample, sets = _sampled(docs, width, trees, depth)
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    names = ["doc", "text_hash"]

    def judge(texts: list[str | None]) -> Iterator[tuple]:
        return _features(width, threshold, trees, depth, shared.value)(texts)

    found = annotate(docs, names, [F.col("text")], "high long, low long, size long, labels array<long>, met array<int>", judge)
    features = stored(restored(found, names, ("high", "low", "size", "labels", "met")), "features")
    real = {r["p"]: r["n"] for r in features.select(F.explode("met").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    lengths, counts = np.unique(probe_prefixes(sets, sample.labels, threshold, trees, depth), return_counts=True)
    prefix, recall = choose_prefix([real, dict(zip(lengths.tolist(), counts.tolist(), strict=True))], depth, target_recall)
    return features.drop("met"), prefix, recall


def _matched(docs: DataFrame, features: DataFrame, width: int, threshold: float, depth: int, prefix: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets, and what each linked set found in the forest matched at a prefix."""
    sets = features.where("size > 0").groupBy("high", "low").agg(
        F.count("*").alias("weight"), F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "text_hash")).alias("first"), F.first("labels").alias("labels")
    )
    sets = stored(sets.select(F.xxhash64("high", "low").alias("set_id"), "high", "low", "weight", "first.doc", "first.text_hash", "labels"), "sets")
    nodes = sets.select("set_id", F.posexplode("labels").alias("tree", "label")).select("set_id", F.xxhash64("tree", prefix_of("label", depth, prefix)).alias("node"))
    shared = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    nodes = stored(nodes.join(shared, "node"), "nodes")
    largest = nodes.groupBy("set_id").agg(F.max(F.struct("members", "node")).alias("h"))
    around = nodes.join(largest, "set_id").groupBy("node").agg(F.max("h").alias("h"))  # the largest next to a node
    home = nodes.select("set_id", "node").join(around, "node").groupBy("set_id").agg(F.max("h").alias("h"))
    home = home.select("set_id", F.col("h.node").alias("home"))
    home = home.join(home.groupBy("home").agg(F.count("*").alias("n")), "home")
    blocks = stored(
        home.select("set_id", F.xxhash64("home", F.pmod(F.xxhash64("set_id", F.lit(SEED)), F.ceil(F.col("n") / block))).alias("block")), "blocks"
    )
    meets = nodes.select("node", "set_id").join(blocks, "set_id").select("node", "block").distinct()
    several = meets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    meets = meets.join(several, "node")
    pairs = meets.select("node", F.col("block").alias("a")).join(meets.select("node", F.col("block").alias("b")), "node").where("a < b")
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    sides = pairs.select(F.col("a").alias("block"), F.xxhash64("a", "b").alias("task"), F.lit(0).alias("side")).union(
        pairs.select(F.col("b").alias("block"), F.xxhash64("a", "b").alias("task"), F.lit(1).alias("side"))
    )
    tasks = blocks.select("set_id", F.col("block").alias("task"), F.lit(0).alias("side")).union(blocks.join(sides, "block").select("set_id", "task", "side"))
    wanted = sets.join(blocks.select("set_id"), "set_id").select("doc", "text_hash", "set_id", "weight")
    texts = docs.alias("d").join(
        wanted.alias("w"), F.col("d.doc").eqNullSafe(F.col("w.doc")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    ).select("w.set_id", "w.weight", "d.text")
    texts = texts.dropDuplicates(["set_id"]) if _repeats(features) else texts
    shingles = texts.mapInPandas(_shingles(width), "set_id long, weight long, shingles array<long>")
    found = tasks.join(shingles, "set_id").repartition("task").sortWithinPartitions("task", "set_id")
    found = stored(found.select("task", "side", "set_id", "weight", "shingles").mapInPandas(_verify(threshold), "set_id long, links long, root long"), "links")
    drop_stored(nodes, blocks, pairs)
    return sets, found


def _repeats(features: DataFrame) -> bool:
    """Whether any row is repeated (same id and text)."""
    return not features.groupBy("doc", "text_hash").count().where("count > 1").isEmpty()


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc``, ``text_hash``, ``class_id``, ``n_links``, ``first``.

    ``n_links`` counts the other documents at a Jaccard similarity of at least
    the threshold, ``class_id`` is the smallest id reachable over links (itself
    included) and ``first`` marks one document of each class.  Texts without a
    word (null, empty) have no set: no links, a class of their own.  Repeated
    rows are documents that link with each other; ``first`` is then true for all
    rows equal in id and text.  A null id stays null and stands behind all other
    ids in a class.  Ids must be integers.  Very long texts are sets of all their
    shingles.  An empty table gives an empty result.  Other columns are not read,
    whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    features, prefix, _ = forest(docs, width, threshold, trees, depth, target_recall)
    sets, found = _matched(docs, features, width, threshold, depth, prefix, block)
    comps = components(found.select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    per_set = (
        sets.join(links, "set_id", "left")
        .join(comps.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("high", "low", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "set_id").alias("component"), F.struct(F.col("doc").isNull().alias("n"), "doc", "text_hash").alias("own"))
    )
    firsts = per_set.groupBy("component").agg(F.min("own").alias("head"))
    per_set = per_set.join(firsts, "component").select("high", "low", "head", (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    joined = features.where("size > 0").select("doc", "text_hash", "high", "low").join(per_set, ["high", "low"])
    with_set = joined.select(
        "doc", "text_hash", F.col("head.doc").alias("class_id"), "n_links",
        (F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("first"),
    )
    alone = features.where("size = 0").select("doc", "text_hash", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return with_set.union(alone)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links at five words and 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs).select(F.col("doc").alias("doc_id"), "class_id", "n_links", (F.col("doc").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; texts without a word all stay."""
    classes = jaccard_classes(docs)
    firsts = classes.where("first").groupBy("doc", "text_hash").agg(F.count("*").alias("copies"))
    firsts = stored(firsts, "firsts")
    names = docs.columns
    rows = docs.select(*carried(names), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = rows.alias("k").join(firsts.alias("f"), F.col("k.doc").eqNullSafe(F.col("f.doc")) & (F.col("k.text_hash") == F.col("f.text_hash")), "left_semi")
    if not firsts.where("copies > 1").isEmpty():
        kept = kept.dropDuplicates(["doc", "text_hash"])
    return restored(kept, names)
