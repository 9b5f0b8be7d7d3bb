"""Lexical and vector search as relational algebra.

An index is three tables (postings, document lengths, term statistics); a search
joins the exploded query terms with the postings.  Filters by metadata are semi
joins before scoring, so they prune instead of masking scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import search_text
from ..sources.shared import stored

K1, B = 1.5, 0.75
TOKEN = r"(?U)\b\w\w+\b"
#: Query terms or vectors up to which a side is broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a side after counting that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tokenize(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, doc, tf
    lengths: DataFrame  # doc, length
    terms: DataFrame  # term, idf
    average: float
    documents: int

    def save(self, path: str) -> None:
        for name in ("postings", "lengths", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.lengths.sparkSession.createDataFrame([(self.average, self.documents)], "average double, documents long").write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        parts = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")]
        totals = spark.read.parquet(f"{path}/totals").first()
        return cls(*parts, totals["average"], totals["documents"])


def build_index(docs: DataFrame, doc: str, text: str) -> LexicalIndex:
    """BM25 statistics; a corpus without documents raises.  A document without words has length 0."""
    words = docs.select(F.col(doc).alias("doc"), tokenize(F.coalesce(text, F.lit(""))).alias("words"))
    lengths = words.select("doc", F.size("words").alias("length"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    if not totals["n"]:
        raise ValueError("an index needs documents")
    postings = words.select("doc", F.explode("words").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
    n = totals["n"]
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return LexicalIndex(postings, lengths, terms, totals["average"] or 1.0, n)


def query_text(question: Column, tickers: Column, years: Column, scopes: Column) -> Column:
    """The question and sorted metadata terms, with the accent-free copy."""
    terms = F.concat_ws(" ", F.array_sort(tickers), F.array_sort(F.transform(years, lambda y: y.cast("string"))), F.array_sort(scopes))
    return search_text(F.concat_ws(" ", question, F.nullif(terms, F.lit(""))))


def search(index: LexicalIndex, queries: DataFrame, top_k: int, allowed: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """``qid``, ``doc``, ``score``, ``rank`` of matching documents, best first, ties by document.

    ``queries`` has ``qid`` and ``text``; ``allowed`` (``qid``, ``doc``) restricts
    what a query may return.  A term counts as often as the query has it.  Scores
    are rounded before ranking so that ties do not depend on summation order.
    """
    wanted = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    hits = index.postings.join(small(wanted.join(index.terms, "term")), "term")
    if allowed is not None:
        hits = hits.join(allowed, ["qid", "doc"], "left_semi")
    hits = hits.join(index.lengths, "doc")
    weight = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(index.average)))
    scored = hits.groupBy("qid", "doc").agg(F.round(F.sum(weight), digits).alias("score"))
    return top_ranked(scored, ["qid"], [F.desc("score"), F.asc("doc")], top_k)


#: Numbers of a matrix of query weights that a task holds, and of a matrix of documents scored at once.
MOST_WEIGHTS, DOC_WEIGHTS = 20_000_000, 4_000_000


def search_texts(docs: DataFrame, doc: str, text: str, queries: DataFrame, top_k: int, digits: int = 9) -> DataFrame:
    """`search` of texts that have no index: their words are read once and scored against all queries by matrix products.

    Of each document the length and the counts of words that some query has are
    kept; other words give no score.  Large sets of queries, and tables in which
    a document stands twice, go by way of an index.
    """
    general = lambda: search(build_index(docs, doc, text), queries, top_k, digits=digits)
    wanted = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = wanted.limit(BROADCAST_ROWS + 1).collect()
    qids, vocabulary = list({r["qid"]: None for r in asked}), sorted({r["term"] for r in asked})
    if not asked or len(asked) > BROADCAST_ROWS or len(qids) * len(vocabulary) > MOST_WEIGHTS:
        return general()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            lengths = words.value_lengths().to_numpy(zero_copy_only=False)
            at = pc.index_in(words.flatten().cast(pa.string()), pa.array(vocabulary, pa.string()))
            known = at.is_valid().to_numpy(zero_copy_only=False)
            pairs = np.repeat(np.arange(len(lengths)), lengths)[known] * len(vocabulary) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known]
            pairs, counts = np.unique(pairs, return_counts=True)
            offsets = np.searchsorted(pairs // len(vocabulary), np.arange(len(lengths) + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(lengths.astype(np.int32)), listed(pairs % len(vocabulary)), listed(counts)], ["doc", "length", "at", "tf"])

    kind = docs.schema[doc].dataType.simpleString()
    words = docs.select(F.col(doc).alias("doc"), tokenize(F.coalesce(text, F.lit(""))).alias("words"))
    held = stored(words.mapInArrow(count, f"doc {kind}, length int, at array<int>, tf array<int>"), "words")
    totals = held.agg(F.count("*").alias("n"), F.avg("length").alias("average"), F.countDistinct("doc").alias("docs")).first()
    if totals["n"] == 0 or totals["docs"] != totals["n"]:
        return general()
    n, average = totals["n"], totals["average"] or 1.0
    df = {r["at"]: r["df"] for r in held.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect()}
    weights, place, column = np.zeros((len(vocabulary), len(qids))), {t: i for i, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(qids)}
    for r in asked:
        if own := df.get(place[r["term"]]):
            weights[place[r["term"]], column[r["qid"]]] = r["qtf"] * math.log(1 + (n - own + 0.5) / (own + 0.5))
    step = max(1, DOC_WEIGHTS // max(len(vocabulary), len(qids)))
    shared = held.sparkSession.sparkContext.broadcast(weights)
    qid_kind = queries.schema["qid"].dataType
    keys = held.sparkSession.createDataFrame([(i, q) for i, q in enumerate(qids)], T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("qid", qid_kind)]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("doc"), null_placement="at_start"))
            sizes, lengths = (batch.column("at").value_lengths().to_numpy(zero_copy_only=False), batch.column("length").to_numpy(zero_copy_only=False))
            at, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "tf"))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                own = slice(starts[a], starts[b])
                row, matrix = np.repeat(np.arange(b - a), sizes[a:b]), np.zeros((b - a, len(w)))
                matrix[row, at[own]] = tf[own] / (tf[own] + K1 * (1 - B + B * lengths[a:b][row] / average))
                scores = (matrix @ w).T
                k = min(top_k, b - a)
                least = np.partition(scores, b - a - k, axis=1)[:, b - a - k] - 2 * 10.0**-digits
                q, d = np.nonzero((scores >= least[:, None]) & (scores > 0))
                rounded = _rounded(scores[q, d], digits)
                order = np.lexsort((d, -rounded, q))
                q, d, rounded = q[order], d[order], rounded[order]
                keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(scores)))[q] < k
                yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int32)), batch.column("doc").take(pa.array(d[keep] + a)), pa.array(rounded[keep])], ["_q", "doc", "score"])

    found = held.mapInArrow(score, f"_q int, doc {kind}, score double").join(F.broadcast(keys), "_q").select("qid", "doc", "score")
    return top_ranked(found, ["qid"], [F.desc("score"), F.asc("doc")], top_k)


def top_ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """A dense 1-based ``rank`` in each group, cut at k."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def allowed_by(manifest: DataFrame, queries: DataFrame) -> DataFrame:
    """(``qid``, ``doc``) by ``tickers``, ``years`` and ``scopes``; an empty or null set is no constraint."""
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    q = small(queries.select("qid", "tickers", "years", "scopes"))
    inside = lambda c, v: free(c) | F.array_contains(c, v)
    fits = inside(F.col("tickers"), F.col("ticker")) & inside(F.col("years"), F.col("report_year")) & inside(F.col("scopes"), F.col("scope"))
    return manifest.join(q, fits).select("qid", F.col("table_ref").alias("doc"))


def normalized(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block of documents, of a block of queries, and queries and pairs that are scored at once.
DOC_BLOCK, QUERY_BLOCK, QUERY_STEP, PAIR_STEP = 16_384, 4_096, 256, 1_000_000


def _unit_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of ``dims`` numbers with a length, and all rows `normalized` (others as zeros); sums run in the order of the Columns."""
    v = np.zeros((len(vectors), dims))
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(lengths == dims)
    whole = np.zeros(len(vectors), bool)
    if len(there):
        flat = vectors.take(pa.array(there)).flatten()
        filled = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(there), dims).any(axis=1)
        v[there] = pc.fill_null(flat, 0).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(there), dims)
        whole[there] = filled
    square = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for d in range(dims):
            square += v[:, d] * v[:, d]
        length = np.sqrt(square)
        whole &= (length != 0) | (dims == 0)  # a division by zero is null
        return whole, np.where(whole[:, None], v / length[:, None], 0.0)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up, as the Column rounds the shortest text of a double."""
    scaled = x * 10.0**digits
    with np.errstate(all="ignore"):
        out = np.rint(scaled) / 10.0**digits + 0.0
        near = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _best(whole: np.ndarray, v: np.ndarray, q: np.ndarray, top_k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document, score) of the best documents of each query, documents being in their order.

    A product of matrices finds those that can be among them; their scores are
    then summed in the order of the Columns and rounded, so ties are the same.
    """
    n = int(whole.sum())
    at, own, k = np.flatnonzero(whole), v[whole], min(top_k, n)
    for a in range(0, len(q) if k else 0, QUERY_STEP):
        with np.errstate(all="ignore"):
            scores = q[a : a + QUERY_STEP] @ own.T
        scores[np.isnan(scores)] = np.inf  # a NaN is above all numbers
        least = np.partition(scores, n - k, axis=1)[:, n - k] - 2 * 10.0**-digits
        rows, columns = np.nonzero(scores >= least[:, None])
        exact = np.zeros(len(rows))
        with np.errstate(all="ignore"):
            for b in range(0, len(rows), PAIR_STEP):
                r, c, total = rows[b : b + PAIR_STEP] + a, columns[b : b + PAIR_STEP], exact[b : b + PAIR_STEP]
                for d in range(q.shape[1]):
                    total += own[c, d] * q[r, d]
        exact = _rounded(exact, digits)
        order = np.lexsort((columns, -np.where(np.isnan(exact), np.inf, exact), rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(scores)))
        keep = np.arange(len(rows)) - first[rows] < k
        yield rows[keep] + a, at[columns[keep]], exact[keep]


def _block(docs: pa.Table, queries: pa.Table, top_k: int, digits: int) -> pa.Table:
    """The best documents of one block for each query of one block."""
    docs = docs.take(pc.sort_indices(docs["doc"], null_placement="at_start")).combine_chunks()
    vectors, asked = (t[c].combine_chunks() for t, c in ((docs, "vector"), (queries.combine_chunks(), "vector")))
    vectors, asked = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (vectors, asked))
    lengths = pc.fill_null(pc.list_value_length(asked), -1).to_numpy(zero_copy_only=False)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        sound, q = _unit_rows(asked.take(pa.array(at)), max(int(dims), 0))
        sound &= dims >= 0
        whole, v = _unit_rows(vectors, max(int(dims), 0))
        found += [(at[sound][r], c, s) for r, c, s in _best(whole, v, q[sound], top_k, digits)]
        odd = np.flatnonzero(~whole)[:top_k]  # these have no score and come last, in their order
        found += [(np.repeat(at[sound], len(odd)), np.tile(odd, int(sound.sum())), np.full(len(odd) * int(sound.sum()), np.inf))]
        first = np.arange(min(top_k, len(vectors)))
        found += [(np.repeat(at[~sound], len(first)), np.tile(first, int((~sound).sum())), np.full(len(first) * int((~sound).sum()), np.inf))]
    rows, columns, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    score = pa.array(scores.astype(float), mask=np.isposinf(scores.astype(float)))
    return pa.table({"qid": queries["qid"].take(pa.array(rows)), "doc": docs["doc"].take(pa.array(columns)), "score": score})


def dense_search(vectors: DataFrame, queries: DataFrame, top_k: int, digits: int = 9, allowed: DataFrame | None = None) -> DataFrame:
    """Exact inner products of normalised vectors; ties by position (``doc``).

    Every query (``qid``, ``vector``) is compared with every row: in blocks of
    bounded rows, each pair of blocks in one group, from which only k rows of a
    query leave.  Vectors without a length or of another one have a null score.
    """
    if allowed is not None:
        v = vectors.select("doc", normalized(F.col("vector")).alias("v"))
        q = queries.select("qid", normalized(F.col("vector")).alias("q"))
        scored = v.join(allowed, "doc").join(small(q), "qid").select("qid", "doc", F.round(dot(F.col("v"), F.col("q")), digits).alias("score"))
        return top_ranked(scored, ["qid"], [F.desc("score"), F.asc("doc")], top_k)
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    n, m = blocks(vectors, DOC_BLOCK), blocks(queries, QUERY_BLOCK)
    every = lambda k: F.explode(F.array(*map(F.lit, range(k)))) if k <= 64 else F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    v = vectors.select("doc", "vector", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias("_d"), every(m).alias("_q"))
    q = queries.select("qid", "vector", every(n).alias("_d"), F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int").alias("_q"))
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "qid"), (vectors, "doc"))) + ", score double"
    found = v.groupBy("_d", "_q").cogroup(q.groupBy("_d", "_q")).applyInArrow(lambda a, b: _block(a, b, top_k, digits), kind)
    return top_ranked(found, ["qid"], [F.desc("score"), F.asc("doc")], top_k)


@dataclass
class DenseIndex:
    """Vectors by document, with how many there must be."""

    vectors: DataFrame  # doc, vector
    documents: int

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.vectors.sparkSession.createDataFrame([(self.documents,)], "documents long").write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark, path: str) -> DenseIndex:
        """Raises where vectors are missing or too many."""
        vectors, wanted = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/totals").first()["documents"]
        if (found := vectors.count()) != wanted:
            raise ValueError(f"{wanted} vectors are expected, {found} found")
        return cls(vectors, wanted)


def encode(docs: DataFrame, done: DataFrame | None, encoder: Callable[[list[str]], list[list[float]]], key: str, text: str, batch: int = 256) -> DataFrame:
    """Vectors of the rows that are not ``done`` yet, long texts first so that batches are even."""
    todo = docs if done is None else docs.join(done.select(key), key, "left_anti")
    todo = todo.sortWithinPartitions(F.desc(F.length(text)), F.desc(key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"doc": part[key].to_numpy(), "vector": encoder(part[text].tolist())})

    return todo.select(key, text).mapInPandas(run, f"doc {docs.schema[key].dataType.simpleString()}, vector array<float>")


def augmented(question: Column, ticker: Column, year: Column) -> Column:
    """A question with the lines that manifests carry for a route."""
    line = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"{name}: "), x.cast("string")))
    return F.concat_ws("\n", question, line("ma co phieu", ticker), line("nam bao cao", year))


