"""Benchmark decontamination by greedy string tiling.

A test item leaks into a document if non-overlapping tiles of common words,
each at least ``MIN_MATCH`` words long, cover enough of the item, in whatever
order they stand in the document.  Windows of ``MIN_MATCH`` words are hashed by
a rolling (Karp-Rabin) polynomial; windows shared with an item are its seeds.
Seeds on one diagonal that follow each other are a match; the longest match
among unmarked words is marked as a tile, again and again, until none is left.

Items are taken in blocks of a bounded number of words.  A block is what each
task holds; benchmarks beyond the bound take several passes, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import annotate, carried, restored, stored
from .textkit import shingle_hashes, word_batches

MIN_MATCH = 4
COVERAGE = 0.6
#: Words of benchmark items that a task holds at once.
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22
RESULTS = ("coverage", "item_id", "n_items", "contaminated")


@dataclass
class Items:
    """Test items whose windows are of one width; seeds are sorted by hash."""

    width: int
    number: np.ndarray  # of each item among all
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray


def prepare(rows: list[tuple[object, str | None]], width: int = MIN_MATCH) -> list[Items]:
    """Items with words, by the width of their windows: ``width``, or all of a shorter item's words."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for words in word_batches([t for _, t in rows]):
        h = words.hashes()
        for i in range(words.n_texts):
            own = h[words.offset[i] : words.offset[i + 1]]
            if len(own):
                held.setdefault(min(len(own), width), []).append((words.first + i, own))
    out = []
    for w, own in sorted(held.items()):
        seed, offset = shingle_hashes(np.concatenate([x for _, x in own]), np.concatenate([[0], np.cumsum([len(x) for _, x in own])]), w)
        item = np.repeat(np.arange(len(own)), np.diff(offset))
        order = np.argsort(seed, kind="stable")
        present = np.zeros(1 << FILTER_BITS, bool)
        present[seed & np.uint64((1 << FILTER_BITS) - 1)] = True
        out.append(Items(w, np.array([n for n, _ in own]), [x for _, x in own], seed[order], item[order], (np.arange(len(seed)) - offset[:-1][item])[order], present))
    return out


def tiles(pattern: np.ndarray, text: np.ndarray, at_p: np.ndarray, at_t: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (pattern place, text place, length), given the seeds of both.

    ``at_p``/``at_t`` are the places of equal windows of ``width`` words; hash
    equality is verified word by word.
    """
    real = np.ones(len(at_p), bool)
    for k in range(width):
        real &= pattern[at_p + k] == text[at_t + k]
    at_p, at_t = at_p[real], at_t[real]
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    found = []
    order = np.lexsort((at_p, at_t - at_p))
    at_p, at_t = at_p[order], at_t[order]
    while len(at_p):
        sum_p, sum_t = np.concatenate([[0], np.cumsum(~free_p)]), np.concatenate([[0], np.cumsum(~free_t)])
        open_ = (sum_p[at_p + width] == sum_p[at_p]) & (sum_t[at_t + width] == sum_t[at_t])
        at_p, at_t = at_p[open_], at_t[open_]
        if not len(at_p):
            break
        breaks = np.flatnonzero((np.diff(at_t - at_p) != 0) | (np.diff(at_p) != 1)) + 1
        begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at_p)]])
        length = end - begin + width - 1
        best = np.lexsort((at_t[begin], at_p[begin], -length))[0]
        p, t, n = int(at_p[begin[best]]), int(at_t[begin[best]]), int(length[best])
        free_p[p : p + n], free_t[t : t + n] = False, False
        found.append((p, t, n))
    return found


def scan(texts: list[str | None], groups: list[Items], coverage: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sub-batches: first text; best coverage, its item's number (or -1) and number of leaked items of each text."""
    for words in word_batches(texts):
        best, which, leaked = np.zeros(words.n_texts), np.full(words.n_texts, -1), np.zeros(words.n_texts, np.int64)
        h = words.hashes() if groups and len(words.start) else None
        for items in groups if h is not None else ():
            _match(h, words.offset, items, coverage, best, which, leaked)
        yield words.first, best, which, leaked


def _match(h: np.ndarray, word_offset: np.ndarray, items: Items, coverage: float, best: np.ndarray, which: np.ndarray, leaked: np.ndarray) -> None:
    """Adds what the texts share with items of one width."""
    w = items.width
    shingles, offset = shingle_hashes(h, word_offset, w)
    hit = np.flatnonzero(items.present[shingles & np.uint64((1 << FILTER_BITS) - 1)])
    a, b = np.searchsorted(items.seed, shingles[hit], "left"), np.searchsorted(items.seed, shingles[hit], "right")
    hit, a, n = hit[b > a], a[b > a], (b - a)[b > a]
    row = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, item, place = np.repeat(hit, n), items.item[row], items.place[row]
    text = np.searchsorted(offset, at, "right") - 1
    order = np.argsort(text * len(items.words) + item, kind="stable")
    pair = (text * len(items.words) + item)[order]
    for rows in np.split(order, np.flatnonzero(np.diff(pair)) + 1) if len(order) else []:
        i, j = int(text[rows[0]]), int(item[rows[0]])
        pattern, number = items.words[j], int(items.number[j])
        reach = np.zeros(len(pattern) + 1, np.int64)  # no tiling covers more than the seeds do
        seeds = np.unique(place[rows])
        np.add.at(reach, seeds, 1)
        np.add.at(reach, seeds + w, -1)
        if (np.cumsum(reach)[:-1] > 0).mean() < coverage and best[i] >= coverage:
            continue
        own = h[word_offset[i] : word_offset[i + 1]]
        covered = sum(k for *_, k in tiles(pattern, own, place[rows], at[rows] - offset[i], w)) / len(pattern)
        leaked[i] += covered >= coverage
        if covered > best[i] or (covered == best[i] > 0 and number < which[i]):
            best[i], which[i] = covered, number


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[object, str | None]]]:
    out, held, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).orderBy(id_col).toLocalIterator():
        n = len((row[1] or "").split())
        if held and size + n > BLOCK_WORDS:
            out.append(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    return [*out, held]


def _scanned(docs: DataFrame, columns: list[str], text: Column, block: list[tuple[object, str | None]], width: int, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(([key for key, _ in block], prepare(block, width)))

    def judge(texts: list[str | None]) -> Iterator[tuple]:
        ids, groups = shared.value
        for first, best, which, leaked in scan(texts, groups, coverage):
            yield first, best, [ids[j] if j >= 0 else None for j in which], leaked

    return annotate(docs, columns, [text], "coverage double, item_id long, n_items long", judge)


def leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str], id_col="item_id", text_col="text", width: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``columns`` of ``docs``, ``coverage``, ``item_id`` (best item), ``n_items`` and ``contaminated``.

    A result replaces a column of its name.  A text that is null, empty or shares no window has coverage 0 and a null
    item.  Items without words match nothing; an item shorter than the window
    is matched as a whole, wherever its words stand in a text.  Of items
    equally covered the one first in id order is given.  Very long texts are
    scanned whole.  Repeated documents are judged alike; an empty table of either
    kind gives no leak.
    """
    return restored(_leaks(docs, benchmark, columns, id_col, text_col, width, coverage), columns, RESULTS)


def _leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str], id_col="item_id", text_col="text", width: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """`leaks` with `carried` columns."""
    text = F.col("text").cast("string")
    first, *others = blocks = _blocks(benchmark, id_col, text_col)
    if not others:
        return _scanned(docs, columns, text, first, width, coverage).withColumn("contaminated", F.col("n_items") > 0)
    # A pass for each block finds what it can say of each text; then these join with the documents.
    keyed = docs.select(F.unhex(F.sha1(text)).alias("key"), text.alias("text"))
    parts = [stored(_scanned(keyed, ["key"], F.col("text"), b, width, coverage).where("coverage > 0").distinct(), "leaks") for b in blocks]
    found = reduce(DataFrame.union, parts).withColumnRenamed("_p0", "key")
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("b")
    found = found.groupBy("key").agg(best, F.sum("n_items").alias("n_items"))
    own = docs.select(*carried(columns), F.unhex(F.sha1(text)).alias("key")).join(found, "key", "left")
    return own.select(
        *[f"_p{i}" for i in range(len(columns))], F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), (-F.col("b.i")).alias("item_id"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best covered test item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark, ["doc_id"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those into which a test item leaked."""
    return restored(_leaks(docs, benchmark, docs.columns).where("not contaminated"), docs.columns)
