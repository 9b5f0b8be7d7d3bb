"""Document scores by masked pseudo-likelihood.

Every word is predicted from the words on both of its sides.  A window network
(position-wise embeddings of the neighbours' leaves, one hidden layer) walks a
tree of two levels: it gives the probability of a group and, in the group, of a
leaf; both are normalised over all their outputs.  The commonest words are leaves
of their own, in groups of equal rank; all others belong to a leaf by their
ending, in which a word has the probability of its own count.  A document's score
is the sum of its words' conditional log-probabilities.

Words are counted over all documents, and every word has the probability of its
own count.  The commonest words' are looked up in a bounded vocabulary; the
others of each document are joined with the stored table of counts, which also
tells how many of its words occur nowhere else (``n_once``).  The network is
learned from all documents: its biases start from the counts of all words, and
documents are dealt by their texts to `BLOCKS` blocks, along whose gradients over
all windows it descends one after the other.  Such a gradient is a sum that does
not depend on how rows are dealt to tasks.  Only these sums, as large as the
network, and the bounded vocabulary reach the driver.  Texts become leaves once,
in a stored table that the descent and the scoring read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .cluster import annotate, drop_stored, new_path, restored, stored
from .textkit import U64, Words, word_batches

#: The tree: groups of leaves; the first groups hold the commonest words, the others endings.
GROUPS = 64
LEAVES = 64
TOP = GROUPS // 2 * LEAVES
CLASSES = GROUPS * LEAVES
ENDINGS = CLASSES - TOP
#: What stands beyond the text, an input alone.
BEYOND = CLASSES
#: Words whose probabilities are broadcast; those of all others come from a join with the counts.
VOCABULARY = 32_768
HIDDEN = 24
REACH = 2
OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)
#: Windows of one update of `Trainer.learn`, and its rate.
UPDATE = 2048
RATE = 0.01
#: Windows of one product, whose scores stay in the processor's cache.
BATCH = 1024
#: Blocks of documents, an update for each, and the rate of the first; it falls evenly to none.
BLOCKS = 16
BLOCK_RATE = 0.15
#: Characters whose words are found, and words whose windows are walked, at once (or one longer text).
CHARACTERS = 1_000_000
WORDS = 131_072
#: Numbers in one row of a task's gradient; tasks beyond so many are first added to so many partial sums.
CHUNK = 16_384
PARTIAL_SUMS = 64


@dataclass
class Vocabulary:
    """Hashes of vocabulary words in order, their leaves and log-probabilities within them."""

    word: np.ndarray
    cls: np.ndarray
    log_p: np.ndarray
    once_log_p: np.ndarray  # per ending, of a word counted once; a word counted n times adds log n
    leaf_n: np.ndarray  # words of each leaf, over all documents


def endings(words: Words) -> np.ndarray:
    """The leaf of each word by its last three characters, from TOP onwards."""
    tail = np.minimum(words.end - words.start, 3)
    return TOP + (words.span_hash(words.end - tail, words.end) % U64(ENDINGS)).astype(np.int64)


def classes(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, log-probability within it (as if counted once, if not in the vocabulary), hash and membership of each word."""
    h, out, known = words.hashes(), endings(words), np.zeros(len(words.start), bool)
    log_p = vocabulary.once_log_p[out - TOP]
    if len(vocabulary.word):
        at = np.minimum(np.searchsorted(vocabulary.word, h), len(vocabulary.word) - 1)
        known = vocabulary.word[at] == h
        out[known], log_p = vocabulary.cls[at[known]], np.where(known, vocabulary.log_p[at], log_p)
    return out, log_p, h, known


def top_only(vocabulary: Vocabulary) -> Vocabulary:
    """The words that are leaves of their own; they settle the leaf of every word."""
    top = vocabulary.cls < TOP
    return Vocabulary(vocabulary.word[top], vocabulary.cls[top], vocabulary.log_p[top], vocabulary.once_log_p, vocabulary.leaf_n)


def windows(cls: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Leaves at each of `OFFSETS` around every word, inside its text; those of one offset lie side by side."""
    low, high, n = offset[:-1], offset[1:], len(cls)
    out = np.full((len(OFFSETS), n), BEYOND, cls.dtype)
    for row, o in zip(out, OFFSETS, strict=True):
        row[max(-o, 0) : n - max(o, 0)] = cls[max(o, 0) : n - max(-o, 0)]
        for k in range(abs(o)):  # what the shift took from the next text
            edge = low + k if o < 0 else high - 1 - k
            row[edge[(edge >= low) & (edge < high)]] = BEYOND
    return out.T


SHAPES = {
    "embed": (len(OFFSETS), CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "leaf": (GROUPS, HIDDEN, LEAVES), "leaf_bias": (GROUPS, LEAVES),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one flat vector of weights."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh_weights(seed: int = 13) -> np.ndarray:
    return (np.random.default_rng(seed).normal(size=SIZE) * 0.1).astype(np.float32)


class Network:
    """Weights as the walk multiplies them.

    Hidden units have one more that is always 1, so biases are rows of the
    weights.  A group's outputs are those of all groups and then its leaves.
    """

    def __init__(self, flat: np.ndarray) -> None:
        w = split(flat)
        self.inputs = [np.pad(table, ((0, 0), (0, 1))) for table in w["embed"]]
        self.inputs[0][:, :HIDDEN] += w["bias"]
        self.inputs[0][:, HIDDEN] = 40  # its hyperbolic tangent is 1
        groups = np.vstack([w["group"], w["group_bias"]])
        self.outputs = [np.hstack([groups, np.vstack([leaf, bias])]) for leaf, bias in zip(w["leaf"], w["leaf_bias"], strict=True)]
        #: No score is beyond the sum of its weights' sizes.
        self.small = all(np.abs(out).sum(0).max() <= 60 for out in self.outputs)

    def exponentials(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of scores (group or leaf, output, window): in place their exponentials; the sums over outputs and the sums' logarithms for the scores themselves.

        Scores are shifted by the greatest only where some score is too large to
        be raised in single precision.
        """
        shift = z.max(1) if not self.small and max(z.max(), -z.min()) > 60 else None
        if shift is not None:
            z -= shift[:, None]
        np.exp(z, out=z)
        total = z.sum(1)
        return total, np.log(total) + (0 if shift is None else shift)


def walk(network: Network | np.ndarray, x: np.ndarray, y: np.ndarray, grad: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of leaf ``y`` for each window ``x``; adds the gradient of its negative sum to ``grad``."""
    net = network if isinstance(network, Network) else Network(network)
    g, n = split(grad) if grad is not None else None, len(y)
    order = np.argsort((y // LEAVES).astype(np.uint16), kind="stable")  # products of one group each
    y, near = y[order].astype(np.intp), [x[:, k].take(order).astype(np.intp) for k in range(len(OFFSETS))]
    group, leaf = np.divmod(y, LEAVES)
    logs, every, dtype = np.empty(n), np.arange(min(n, BATCH)), net.outputs[0].dtype
    scores, dh = np.empty((GROUPS + LEAVES) * len(every), dtype), np.empty((HIDDEN, n), dtype) if g is not None else None
    cuts = np.searchsorted(group, np.arange(GROUPS + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        out = net.outputs[k]
        across, total_g = np.ascontiguousarray(out.T), 0.0
        for a in range(cuts[k], cuts[k + 1], BATCH):
            s = slice(a, min(a + BATCH, cuts[k + 1]))
            m = s.stop - a
            hidden = net.inputs[0].take(near[0][s], axis=0, mode="clip")
            for table, own in zip(net.inputs[1:], near[1:], strict=True):
                hidden += table.take(own[s], axis=0, mode="clip")
            hidden = np.tanh(hidden.T, order="C")
            cells, at = scores[: len(across) * m], (GROUPS + leaf[s]) * m + every[:m]
            z = np.matmul(across, hidden, out=cells.reshape(-1, m))  # (output, window): sums and scales run along the windows
            mine = z[k] + cells.take(at)
            both = z.reshape(2, -1, m)
            total, log_total = net.exponentials(both)
            logs[s] = mine - log_total.sum(0)
            if g is None:
                continue
            both *= 1 / total[:, None]
            z[k] -= 1
            cells[at] -= 1
            total_g = total_g + z @ hidden.T
            dh[:, s] = out[:HIDDEN] @ z
            hidden = hidden[:HIDDEN]
            dh[:, s] *= 1 - hidden * hidden
        if g is not None:
            total_g = total_g.T
            g["group"] += total_g[:HIDDEN, :GROUPS]
            g["group_bias"] += total_g[HIDDEN, :GROUPS]
            g["leaf"][k] += total_g[:HIDDEN, GROUPS:]
            g["leaf_bias"][k] += total_g[HIDDEN, GROUPS:]
    if g is not None and n:
        for unit, back in enumerate(dh):
            back = back.astype(np.float64)
            g["bias"][unit] += back.sum()
            for table, own in zip(g["embed"], near, strict=True):
                table[:, unit] += np.bincount(own, back, CLASSES + 1)
    found = np.empty(n)
    found[order] = logs
    return found


class Trainer:
    """Adam on the cross-entropy of the masked word's leaf."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32).copy()
        self.m, self.v, self.step = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, len(y), UPDATE):
            grad = np.zeros(SIZE, np.float32)
            walk(self.flat, x[a : a + UPDATE], y[a : a + UPDATE], grad)
            self.update(grad / len(y[a : a + UPDATE]), RATE)

    def update(self, grad: np.ndarray, rate: float) -> None:
        """A step along the gradient of a mean."""
        grad = grad.astype(np.float32)
        self.step += 1
        self.m = np.float32(0.9) * self.m + np.float32(0.1) * grad
        self.v = np.float32(0.99) * self.v + np.float32(0.01) * grad**2
        self.flat -= (rate * (self.m / (1 - 0.9**self.step)) / self.scale()).astype(np.float32)

    def scale(self) -> np.ndarray:
        """The size of a usual gradient of each weight."""
        return np.sqrt(self.v / (1 - 0.99 ** max(self.step, 1))) + 1e-6


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``ending`` and ``n`` over all texts; each batch is summed before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for words in word_batches(pdf["text"].tolist(), at_once=CHARACTERS):
                h, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pd.DataFrame({"word": h.view(np.int64), "ending": endings(words)[first], "n": n})

    counts = docs.select("text").mapInPandas(run, "word long, ending int, n long")
    return counts.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The commonest words (of those that occur again), ties by hash, and the weight of one count in each leaf of endings."""
    rows = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(size).toPandas()
    totals = {r["ending"]: r["n"] for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect()}
    word, cls, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["ending"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    top = np.arange(len(word)) < TOP
    mass = np.zeros(ENDINGS)
    for ending, total in totals.items():
        mass[ending - TOP] = total
    np.subtract.at(mass, cls[top] - TOP, n[top])  # words that are leaves of their own leave theirs
    log_p = np.zeros(len(word))
    log_p[~top] = np.log(n[~top] / mass[cls[~top] - TOP])
    once = -np.log(np.maximum(mass, 1))
    cls = np.where(top, np.arange(len(word)), cls)
    order = np.argsort(word)
    return Vocabulary(word[order], cls[order], log_p[order], once, np.concatenate([np.pad(n[top], (0, TOP - top.sum())), mass]))


def encoded(docs: DataFrame, columns: list[str], vocabulary: Vocabulary) -> DataFrame:
    """`carried` columns of ``docs`` and what its texts are to the network.

    ``leaves`` are those of a text's words, ``within`` is the sum of the words'
    log-probabilities in their leaves, ``others`` are the hashes of words outside
    the vocabulary, each as if counted once, and ``block`` is the block of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def judge(texts: list[str | None], blocks: list[int]) -> Iterator[tuple]:
        for words in word_batches(texts, at_once=CHARACTERS):
            y, log_p, h, known = classes(words, shared.value)
            before = np.concatenate([[0], np.cumsum(~known)])[words.offset]
            others = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(h[~known].view(np.int64)))
            leaves = pa.ListArray.from_arrays(pa.array(words.offset, pa.int32()), pa.array(y.astype(np.int16)))
            yield words.first, np.diff(words.offset), np.bincount(words.text_of_word(), log_p, words.n_texts), others, leaves, blocks[words.first : words.first + words.n_texts]

    text = F.col("text").cast("string")
    block = F.pmod(F.xxhash64(text, F.lit(37)), F.lit(BLOCKS)).cast("int")
    return annotate(docs, columns, [text, block], "n_words long, within double, others array<long>, leaves array<short>, block int", judge)


def in_blocks(rows: DataFrame) -> DataFrame:
    """`encoded` rows in a stored table with a folder for each block."""
    path = new_path(rows.sparkSession, "leaves")
    rows.write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _windows_of(leaves: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole texts at a time: the first, the words' offsets, windows and leaves."""
    offset, every = leaves.offsets.to_numpy().astype(np.int64), leaves.flatten().to_numpy()
    offset, first = offset - offset[0], 0
    while first < len(leaves):
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + WORDS, "right")) - 1)
        y, own = every[offset[first] : offset[last]], offset[first : last + 1] - offset[first]
        yield first, own, windows(y, own), y
        first = last


def gradient(docs: DataFrame, flat: np.ndarray, top: Vocabulary) -> tuple[np.ndarray, int]:
    """The gradient of the cross-entropy over all windows of all documents (texts or `encoded` rows), and their number.

    Each task sums its windows; the sums of many tasks are added in two rounds, so
    that no row has more to add than some tasks, however many there are.
    """
    rows = (docs if "leaves" in docs.columns else encoded(docs, [], top)).select("leaves")
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, total, n = Network(shared.value), np.zeros(SIZE), 0
        for batch in batches:
            for _, _, x, y in _windows_of(batch.column(0)):
                for a in range(0, len(y), WORDS):
                    walk(network, x[a : a + WORDS], y[a : a + WORDS], total)
                n += len(y)
        if n:
            cuts = np.append(np.arange(0, SIZE, CHUNK), SIZE)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(cuts) - 1, TaskContext.get().partitionId() % PARTIAL_SUMS, np.int32)), "chunk": pa.array(np.arange(len(cuts) - 1, dtype=np.int32)),
                "total": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(total.astype(np.float32))), "n": pa.array(np.full(len(cuts) - 1, n)),
            })

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for part, chunk, total, n in zip(pdf["part"], pdf["chunk"], pdf["total"], pdf["n"], strict=True):
                old = sums.get((part, chunk), (0.0, 0))
                sums[part, chunk] = (old[0] + np.asarray(total, np.float64), old[1] + n)
        if sums:
            yield pd.DataFrame([(*key, total, n) for key, (total, n) in sums.items()], columns=["part", "chunk", "total", "n"])

    kinds = "part int, chunk int, total array<float>, n long"
    sums = rows.mapInArrow(run, kinds)
    if rows.rdd.getNumPartitions() > PARTIAL_SUMS:
        sums = sums.repartition(PARTIAL_SUMS, "part").mapInPandas(added, kinds)
    found = sums.withColumn("part", F.lit(0)).repartition(4, "chunk").mapInPandas(added, kinds).orderBy("chunk").collect()
    shared.destroy()
    if not found:
        return np.zeros(SIZE), 0
    return np.concatenate([np.asarray(r["total"]) for r in found]), found[0]["n"]


def start(docs: DataFrame, top: Vocabulary) -> Trainer:
    """The network after an update for each block of all documents, texts or rows `in_blocks`."""
    rows = docs if "leaves" in docs.columns else in_blocks(encoded(docs, [], top))
    flat, n = fresh_weights(), top.leaf_n.reshape(GROUPS, LEAVES) + 1
    w = split(flat)
    w["group_bias"][:], w["leaf_bias"][:] = np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True))
    trainer = Trainer(flat)
    for k in range(BLOCKS):
        total, n = gradient(rows.where(F.col("block") == k), trainer.flat, top)
        if n:
            trainer.update(total / n, BLOCK_RATE * (1 - k / BLOCKS))
    if rows is not docs:
        drop_stored(rows)
    return trainer


def train(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The network learned from all documents, texts or rows `in_blocks`."""
    return np.round(start(docs, top_only(vocabulary)).flat, 5).astype(np.float32)


def score_rows(rows: DataFrame, flat: np.ndarray) -> DataFrame:
    """`encoded` rows with ``base``, the sum of their words' log-probabilities as if those outside the vocabulary were counted once."""
    kept = [f for f in rows.schema if f.name not in ("leaves", "within", "block")]
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        for batch in batches:
            base = batch.column("within").to_numpy().copy()
            for first, offset, x, y in _windows_of(batch.column("leaves")):
                logs = np.empty(len(y))
                for a in range(0, len(y), WORDS):
                    logs[a : a + WORDS] = walk(network, x[a : a + WORDS], y[a : a + WORDS])
                text = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
                base[first : first + len(offset) - 1] += np.bincount(text, logs, len(offset) - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(base)], names=[*names, "base"])

    return rows.drop("block").mapInArrow(run, StructType([*kept, StructField("base", DoubleType())]))


def pseudo_likelihood(docs: DataFrame, columns: list[str], size: int = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs``, ``per_word``, ``log_likelihood``, ``n_once`` and ``n_words``.

    ``n_once`` counts the words that all documents hold once; a text that stands
    there twice has none.  Texts
    without a word (null, empty) have 0 words, a sum of 0 and a null mean.  Very
    long texts are scored over all their windows.  Repeated rows score alike (to
    the precision of single floats, 1e-6 a word), an empty table gives an empty result.  Other columns are not read; a result
    replaces a column of its name.  ``size`` (`TOP` at least) is that of the
    broadcast vocabulary and changes no score.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = stored(count_words(texts), "words")
    vocabulary = vocabulary_of(counts, size)
    rows = in_blocks(encoded(docs, columns, vocabulary))
    scored = score_rows(rows, train(rows, vocabulary))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    drop_stored(rows)
    # No word outside the vocabulary is in more than a small share of the rows, so neither side has a hot key.
    # Words counted once add log 1 = 0.  The sum is in whole 1e-9, so its order does not matter.
    often = counts.where("n > 1").select("word", F.round(F.log("n") * 1e9).cast("long").alias("log_n"))
    more = scored.select("row", F.explode("others").alias("word")).join(often, "word").groupBy("row").agg(F.sum("log_n").alias("log_n"), F.count("*").alias("known"))
    once = F.size("others") - F.coalesce("known", F.lit(0))
    scored = scored.join(more, "row", "left").withColumn("n_once", once.cast("long")).drop("others")
    scored = scored.withColumn("log_likelihood", F.col("base") + F.coalesce(F.col("log_n") / 1e9, F.lit(0.0)))
    scored = scored.withColumn("per_word", F.try_divide("log_likelihood", "n_words"))
    return restored(scored, columns, ("per_word", "log_likelihood", "n_once", "n_words"))


def op9_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
