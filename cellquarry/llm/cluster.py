"""Shared-storage and graph helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.shared import drop_stored, new_path, shared_dir, stored

__all__ = ["annotate", "carried", "components", "drop_stored", "new_path", "restored", "shared_dir", "stored"]


def carried(columns: list[str]) -> list[Column]:
    """``columns`` under positional names, so that no name can clash with an operator's own."""
    return [F.col(f"`{c.replace('`', '``')}`").alias(f"_p{i}") for i, c in enumerate(columns)]


def restored(df: DataFrame, columns: list[str], results: tuple[str, ...] = ()) -> DataFrame:
    """Undoes `carried`, with ``results`` after the columns; a result replaces a column of its name."""
    own = {r.lower() for r in results}
    return df.select(*[F.col(f"_p{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in own], *results)


def annotate(docs: DataFrame, columns: list[str], inputs: list[Column], results: str, judge: Callable[..., Iterator[tuple]]) -> DataFrame:
    """`carried` columns of ``docs`` and the ``results`` (DDL) that ``judge`` finds for each row.

    ``judge`` gets a batch's values of each of ``inputs`` as lists and yields, for
    one slice of the batch after another, its first row and a sequence (or Arrow
    array) for each result.  Carried columns pass through as Arrow, whatever their type or nulls.
    """
    source = docs.select(*carried(columns), *[x.alias(f"_i{i}") for i, x in enumerate(inputs)])
    found, n = StructType.fromDDL(results), len(columns)
    kinds = [to_arrow_type(f.dataType) for f in found]
    names = [f"_p{i}" for i in range(n)] + found.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, *values in judge(*[c.to_pylist() for c in batch.columns[n:]]):
                part = batch.slice(first, len(values[0])).columns[:n]
                yield pa.RecordBatch.from_arrays([*part, *[v.cast(k) if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(values, kinds, strict=True)]], names=names)

    return source.mapInArrow(run, StructType([*source.schema.fields[:n], *found.fields]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating stars.

    ``edges`` has two bigint columns ``u`` and ``v``.  Returns ``node`` and
    ``component`` (the smallest node reachable) for every node with an edge to
    another.  Each round hangs every node's larger neighbours, then its smaller
    ones, below the smallest; O(log^2 n) rounds reach the fixed point, a set of
    stars.  A round's table is written to the shared folder, so a lost executor
    costs one round at most, and nothing is collected but two totals.
    """
    current = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    size = None
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        following = stored(small.where("u <> v").distinct(), "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(current)
        current = following
        if tuple(now) == size:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        size = tuple(now)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
