"""Toxicity scores from a character n-gram linear classifier with naive Bayes features.

A text's features are the character n-grams (2 to 6 characters, word boundaries
included) and whole words of its distinct words, hashed.  A feature's value is
the number of distinct words that hold it over the square root of the number of
distinct words, so a word's part of the score is computed once for each distinct
word and repeats count for nothing.  Every feature is scaled by its naive Bayes
log-count ratio between toxic and other training texts; a logistic regression
with a ridge penalty is trained on the scaled features in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import annotate, restored
from .textkit import U64, Words, mix, word_batches

HASH_BITS = 20
ORDERS = (2, 3, 4, 5, 6)
#: Labelled documents of each label in the training sample (the documented bound).
TRAIN_PER_LABEL = 1500
RIDGE = 0.01
STEPS = 120


@dataclass
class Model:
    weights: np.ndarray  # per feature: coefficient times log-count ratio
    bias: float


def word_features(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs, each once, of the words at the given indexes."""
    start, end = words.start[at], words.end[at]
    length, who = end - start, np.arange(len(at))
    owners, slots = [who], [_slot(words.span_hash(start, end), 3, 0)]
    for n in ORDERS:
        # One boundary stands before and one behind the word; an n-gram at an edge holds n - 1 of its characters.
        for kind, k in ((1, n - 1), (2, n - 1)):
            fits = np.flatnonzero(length >= k)
            a = start[fits] if kind == 1 else end[fits] - k
            owners.append(fits)
            slots.append(_slot(words.span_hash(a, a + k), kind, n))
        count = np.maximum(length - n + 1, 0)
        owner = np.repeat(who, count)
        a = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        owners.append(owner)
        slots.append(_slot(words.span_hash(a, a + n), 0, n))
    return np.concatenate(owners), np.concatenate(slots)


def _slot(h: np.ndarray, kind: int, n: int) -> np.ndarray:
    return (mix(h ^ U64((kind * 16 + n) * 0x9E3779B1)) >> U64(64 - HASH_BITS)).astype(np.int64)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representative word indexes of the vocabulary, and (text, vocabulary) of each text's distinct words."""
    _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pairs = np.unique(words.text_of_word() * max(1, len(first)) + back)
    return first, pairs // max(1, len(first)), pairs % max(1, len(first))


def train(rows: list[tuple[str | None, int]]) -> Model:
    """Fits the classifier to (text, label) pairs."""
    docs, words_of, owners, slots = [], [], [], []
    place: dict[int, int] = {}  # of each distinct word; a word's features are made once
    for words in word_batches([t for t, _ in rows]):
        first, text, which = _distinct(words)
        own = words.hashes()[first].tolist()
        new = np.array([i for i, h in enumerate(own) if h not in place], np.int64)
        begin = len(place)
        place.update((own[i], begin + k) for k, i in enumerate(new))
        at = np.array([place[h] for h in own], np.int32)
        docs.append((text + words.first).astype(np.int32))
        words_of.append(at[which])
        if len(new):
            owner, slot = word_features(words, first[new])
            owners.append((owner + begin).astype(np.int32))
            slots.append(slot.astype(np.int32))
    doc, word, owner, slot = (np.concatenate(x) for x in (docs, words_of, owners, slots))
    del docs, words_of, owners, slots
    present = np.zeros(1 << HASH_BITS, bool)
    present[slot] = True
    used = np.flatnonzero(present)
    slot = (np.cumsum(present, dtype=np.int32) - 1)[slot]
    y = np.array([label for _, label in rows], np.float64)
    n, v, m = len(rows), len(place), len(used)
    words_in = np.stack([np.bincount(word, y[doc] == c, v) for c in (0, 1)])
    counts = np.stack([np.bincount(slot, c[owner], m) for c in words_in]) + 1.0
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    theta, bias, m1, m2 = np.zeros(m), 0.0, np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, STEPS + 1):
        per_word = np.bincount(owner, (theta * ratio)[slot], v)
        z = np.bincount(doc, per_word[word], n) * scale + bias
        residual = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        back = np.bincount(word, (residual * scale)[doc], v)
        grad = np.append(np.bincount(slot, back[owner], m) * ratio + RIDGE / n * theta, residual.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        theta, bias = theta - move[:-1], bias - move[-1]
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[used] = theta * ratio
    return Model(weights, float(bias))


def score_texts(texts: list[str | None], model: Model) -> Iterator[tuple[int, np.ndarray]]:
    for words in word_batches(texts):
        z = np.zeros(words.n_texts)
        if len(words.start):
            first, text, which = _distinct(words)
            owner, slot = word_features(words, first)
            per_word = np.bincount(owner, model.weights[slot], len(first))
            z = np.bincount(text, per_word[which], words.n_texts) / np.sqrt(np.maximum(np.bincount(text, minlength=words.n_texts), 1))
        yield words.first, 1 / (1 + np.exp(-np.clip(z + model.bias, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled texts of each label, the same for the same rows.

    Only rows whose crc32(doc_id) mod 5 is not 0 are drawn.  Ids are drawn from
    the labels by hash; an id with labels of both kinds counts as toxic.  Every
    drawn id gives a text before any gives a second; which, is settled by hash.
    """
    learnt = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    drawn = labels.where(learnt & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(23))
    picked = [drawn.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_label) for c in (0, 1)]
    picked = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text", F.lit(41)), "text"))
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("turn", turn).where(F.col("turn") <= 4 * per_label)
    rows = rows.orderBy("turn", order, "doc_id").limit(4 * per_label)
    return [(r.text, r.toxic) for r in rows.collect()]


def score(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, ``score`` and ``predicted``; reads ``text`` alone.

    A null or empty text scores as the model's bias says, a very long one by all
    its words.  Without a model (no labelled row of both kinds) every score is 0.
    Repeated rows score alike, an empty table gives an empty result; a result
    replaces a column of its name, whatever its case.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or Model(np.zeros(1 << HASH_BITS, np.float32), -40.0))

    def judge(texts: list[str | None]) -> Iterator[tuple]:
        for first, p in score_texts(texts, shared.value):
            yield first, p, (p >= 0.5).astype(np.int32)

    found = annotate(docs, columns, [F.col("text").cast("string")], "score double, predicted int", judge)
    return restored(found, columns, ("score", "predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = training_rows(docs, labels)
    model = train(rows) if len({label for _, label in rows}) == 2 else None
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
