"""Routes, fusion, scope filters, coverage and candidates over exploded rankings.

A ranking is rows (``qid``, ``ref``, ``rank``), with ``source`` where several are
fused; lists are rebuilt only at sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

DECLARED = ("consolidated", "separate", "aggregated")
RRF_K = 60


def routes(queries: DataFrame) -> DataFrame:
    """Every ticker with every year of a query, sorted; an empty side is null.  ``route`` numbers them."""
    sorted_or_null = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_sort(F.array_distinct(c)))
    out = queries.withColumn("ticker", F.explode_outer(sorted_or_null(F.col("tickers")))).withColumn("year", F.explode_outer(sorted_or_null(F.col("years"))))
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_first("ticker"), F.asc_nulls_first("year"))
    return out.withColumn("route", F.row_number().over(order) - 1)


def route_budget(n_routes: Column, top_k: int) -> tuple[Column, Column]:
    """(results of a query, results of each of its routes)."""
    output = F.greatest(F.lit(top_k), n_routes)
    return output, F.greatest(F.lit(1), F.ceil(output / n_routes)).cast("int")


def widened_scope(scope: Column) -> Column:
    """A stated scope is searched with the unknown one; none is no constraint."""
    return F.when(scope.isNotNull(), F.array(scope, F.lit("unknown"))).otherwise(F.array().cast("array<string>"))


def round_robin(ranked: DataFrame, limit: int) -> DataFrame:
    """Routes take turns by rank; a repeated reference takes no slot.  ``ranked`` has ``route``."""
    first = Window.partitionBy("qid", "ref").orderBy("rank", "route")
    once = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("qid").orderBy("rank", "route")
    out = once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return out.select("qid", "ref", F.col("position").alias("rank"))


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Scores of references over several lists (``source`` in list order), best first.

    In a list only a reference's first rank counts, and later ones still use up
    ranks.  Equal scores go to the reference seen first, list after list.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    best = ranked.groupBy("qid", "source", "ref").agg(F.min("rank").alias("rank"))
    scored = best.groupBy("qid", "ref").agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.min(F.struct("source", "rank")).alias("seen"))
    scored = scored.withColumn("score", F.round("raw", 12))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "ref")
    return scored.withColumn("rank", F.row_number().over(order)).select("qid", "ref", "score", "rank")


def scope_filter(ranked: DataFrame, manifest: DataFrame, policy: str) -> DataFrame:
    """Drops references of another declared scope where the wanted one is ranked for the same ticker and year.

    ``ranked`` has ``scope``, what the question says (or null: ``policy`` then).
    Unknown scopes and references without a manifest row stay.  ``both`` changes
    nothing.
    """
    if policy == "both":
        return ranked
    facts = manifest.select(F.col("table_ref").alias("ref"), "ticker", "report_year", F.col("scope").alias("own"))
    out = ranked.join(facts, "ref", "left").withColumn("target", F.coalesce("scope", F.lit(policy)))
    same = Window.partitionBy("qid", "ticker", "report_year")
    there = F.coalesce(F.max((F.col("own") == F.col("target")).cast("int")).over(same), F.lit(0)) == 1
    against = F.col("own").isin(*DECLARED) & (F.col("own") != F.col("target")) & there & F.col("target").isin(*DECLARED)
    return out.withColumn("_against", F.coalesce(against, F.lit(False))).where("not _against").select(*ranked.columns)


def rerank(candidates: DataFrame, top_k: int) -> DataFrame:
    """By a supplied ``score``, ties by reference."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ref")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def keep_coverage(hits: DataFrame, query_routes: DataFrame, manifest: DataFrame, top_k: int) -> DataFrame:
    """The best hit of every route and then the best others, ranked again.

    ``query_routes`` has ``qid``, ``route``, ``ticker``, ``year`` and ``scopes``;
    null (or an empty list) is no constraint.
    """
    facts = manifest.select(F.col("table_ref").alias("ref"), F.col("ticker").alias("own_ticker"), "report_year", F.col("scope").alias("own_scope"))
    joined = hits.join(facts, "ref").join(query_routes, "qid")
    fits = (F.col("ticker").isNull() | (F.col("ticker") == F.col("own_ticker"))) & (F.col("year").isNull() | (F.col("year") == F.col("report_year")))
    fits &= (F.coalesce(F.size("scopes"), F.lit(0)) <= 0) | F.array_contains("scopes", F.col("own_scope"))
    best = joined.where(fits).groupBy("qid", "route").agg(F.min(F.struct("rank", "ref")).alias("b"))
    needed = best.select("qid", F.col("b.ref").alias("ref"), F.lit(1).alias("needed")).distinct()
    marked = hits.join(needed, ["qid", "ref"], "left").withColumn("needed", F.coalesce("needed", F.lit(0)))
    order = Window.partitionBy("qid").orderBy(F.desc("needed"), "rank")
    chosen = marked.withColumn("_n", F.row_number().over(order))
    n_needed = F.sum("needed").over(Window.partitionBy("qid"))
    chosen = chosen.withColumn("_all", n_needed).where(F.col("_n") <= F.greatest(F.lit(top_k), F.col("_all")))
    again = Window.partitionBy("qid").orderBy("rank")
    return chosen.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= top_k).select("qid", "ref", "score", F.col("_r").alias("rank"))


def candidate_limit(tickers: Column, years: Column, least: int) -> Column:
    return F.greatest(F.lit(least), F.size(tickers) * F.size(years))


def select_candidates(ranked: DataFrame, usable: DataFrame) -> DataFrame:
    """Usable references (with a number) in rank order up to ``limit``, named df1, df2, ...."""
    order = Window.partitionBy("qid").orderBy("rank")
    out = ranked.join(usable.select("ref"), "ref", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("limit"))
    return out.select("qid", "ref", "n", F.concat(F.lit("df"), F.col("n").cast("string")).alias("variable"))


def fit_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Drops the lowest ranked until costs fit; gold rows are never dropped and are paid first."""
    order = Window.partitionBy("qid").orderBy(F.desc("gold"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum("cost").over(order)
    return candidates.withColumn("_spent", spent).where((F.col("_spent") <= budget) | (F.col("gold") == 1)).drop("_spent")


def global_index(df: DataFrame, *order: str) -> DataFrame:
    """A 0-based ``index`` in a total order: places inside range partitions plus what stands before them.

    The ranges are sampled once: the sorted rows are written to the shared folder
    with their partition and place, and everything else is counted from that
    table.  A second range exchange would sample other bounds, and a row could
    then be counted in one partition and stand in another.  Rows equal in
    ``order`` get the places at which they were written.
    """
    at = F.monotonically_increasing_id()  # partition in the high bits, place from bit 33 downwards
    placed = stored(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", at), "placed")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("index", place + F.col("_before")).drop("_part", "_at", "_before")


def shard(df: DataFrame, order: str, n: int, index: int) -> DataFrame:
    """Rows at positions index, index + n, ... of a total order."""
    return global_index(df, order).where(F.pmod("index", F.lit(n)) == index).drop("index")


def limited_shard(df: DataFrame, order: str, limit: int, n: int, index: int) -> DataFrame:
    """As `shard`, of the first ``limit`` rows of the order (the cut is a request's own, made before the rows are dealt)."""
    if limit < 1:
        raise ValueError("a limit from 1 is expected")
    return global_index(df, order).where((F.col("index") < limit) & (F.pmod("index", F.lit(n)) == index)).drop("index")


def reorder(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows in the order of ``wanted.ids`` with their ``pos``."""
    return wanted.select(F.posexplode("ids").alias("pos", key)).join(df, key)


def seeded(key: str, seed: int) -> Column:
    """A hash order of a key's text that any engine can repeat."""
    return F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))


def distractors(gold: DataFrame, manifest: DataFrame, n: int, seed: int) -> DataFrame:
    """n other tables of each question's gold documents, by a seeded hash order."""
    docs = gold.select("qid", "doc_id").distinct()
    others = manifest.join(docs, "doc_id").select("qid", F.col("table_ref").alias("ref")).join(gold.select("qid", "ref"), ["qid", "ref"], "left_anti")
    order = Window.partitionBy("qid").orderBy(seeded("ref", seed), "ref")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
