"""Metrics, audits, run comparison, merging and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import covered_years
from ..functions.numbers import is_close, percentile_or_zero
from ..functions.units import TARGET_DIMENSION, dimension
from ..sources.shared import dealt
from .ranking import routes, seeded, widened_scope

MOST_CELLS = 32
TOKENS_PER_CELL = 22


def f_beta(retrieved: Column, gold: Column, beta: float = 2.0) -> Column:
    """struct(precision, recall, f) of two lists as sets; 0 where undefined."""
    hits, n, m = F.size(F.array_intersect(retrieved, gold)), F.size(F.array_distinct(retrieved)), F.size(F.array_distinct(gold))
    precision, recall = (F.coalesce(F.try_divide(hits, x), F.lit(0.0)) for x in (n, m))
    b = beta * beta
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0)).alias("f"))


def within_tolerance(expected: Column, actual: Column, tolerance: float = 0.01) -> Column:
    """False for anything that is no number; the tolerance itself is within."""
    a, b = expected.try_cast("double"), actual.try_cast("double")
    return F.coalesce(is_close(a, b, 0.0, tolerance), F.lit(False))


def profile(df: DataFrame, value: str) -> list[Column]:
    """min, mean, median, p95 and max, rounded; 0 over nothing."""
    zero = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 3)
    return [
        zero(F.min(value)).alias("min"), zero(F.avg(value)).alias("mean"), F.round(percentile_or_zero(value, 0.5), 3).alias("median"),
        F.round(percentile_or_zero(value, 0.95), 3).alias("p95"), zero(F.max(value)).alias("max"),
    ]


def top_counts(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(key)).limit(n)


def corpus_audit(manifest: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: documents, tables, tickers, bytes, year ends found and the tables per document."""
    per_doc = reports.select("doc_id").distinct().join(manifest.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tables = per_doc.agg(F.count("*").alias("documents"), F.sum("n").alias("tables"), F.struct(*profile(per_doc, "n")).alias("tables_per_document"))
    facts = reports.agg(F.countDistinct("ticker").alias("tickers"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("fiscal_year_end").isNotNull()).alias("year_ends"))
    return tables.crossJoin(facts)


def question_audit(questions: DataFrame) -> DataFrame:
    """One row: questions, distinct ids, whether ids run from 1, empty questions, several years in one."""
    years = F.size(F.array_distinct(F.regexp_extract_all("question", F.lit(r"(20\d\d)"), F.lit(1))))
    return questions.agg(
        F.count("*").alias("questions"), F.countDistinct("id").alias("ids"), ((F.min("id") == 1) & (F.max("id") == F.countDistinct("id")) & (F.count("*") == F.countDistinct("id"))).alias("sequential"),
        F.count_if(F.trim("question") == "").alias("empty"), F.count_if(years > 1).alias("several_years"),
    )


def _served(asked: DataFrame, known: DataFrame, how: str, by: list[str] = []) -> DataFrame:
    """Routes (``ticker``, ``year``, ``scope``) that fit a row of ``known`` (``left_semi``) or none (``left_anti``), within equal ``by``.

    Null asks for nothing and the unknown scope fits all, so each known row
    stands for every way of asking that it fits; then the join is one of equal
    keys and never compares each with each.
    """
    keys = ["_ticker", "_year", "_scope"]
    either = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(None))))
    known = known.select(*by, F.col("own_ticker").alias("_ticker"), F.col("own_year").alias("_year"), F.col("own_scope").alias("_scope")).distinct()
    for k in keys:
        known = known.withColumn(k, either(k))
    known = known.distinct()
    # A stated scope fits itself or the unknown one: two rows of one route, which then are counted as one.
    routed = asked.withColumn("_route", F.struct("ticker", "year", "scope"))
    scopes = F.when(F.col("scope").isNull(), F.array("scope")).otherwise(F.array_distinct(F.array("scope", F.lit("unknown"))))
    ways = routed.select(*by, "_route").distinct().select(*by, "_route", F.col("_route.ticker").alias("_ticker"), F.col("_route.year").alias("_year"), F.col("_route.scope").alias("scope"))
    ways = ways.select(*by, "_route", "_ticker", "_year", F.explode(scopes).alias("_scope"))
    on = lambda names: [F.col(f"w.{c}").eqNullSafe(F.col(f"k.{c}")) for c in names]
    fit = ways.alias("w").join(known.alias("k"), [*on(by), *on(keys)], "left_semi").select(*by, "_route").distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*by, "_route")]
    return routed.alias("r").join(fit.alias("f"), same, how).drop("_route")


def retrieval_violations(retrieval: DataFrame, questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """``id``, ``code``, ``detail`` of every failure of rankings.

    ``retrieval`` has ``id``, ``question``, ``tickers``, ``years``, ``scope`` and
    ``fused``, and may have ``hybrid``, ``reranked`` and ``reranker_scores``.
    Routes that no table could serve are no failure.
    """
    r = retrieval
    code = lambda df, name, detail=F.lit(None): df.select("id", F.lit(name).alias("code"), detail.cast("string").alias("detail"))
    pairs = r.select("id", F.col("question").alias("given"), F.lit(1).alias("p")).join(questions.select("id", "question", F.lit(1).alias("q")), "id", "full_outer")
    out = code(pairs.where(F.col("p").isNull() | F.col("q").isNull() | ~F.col("given").eqNullSafe(F.col("question"))), "row_or_question")
    out = out.union(code(r.where(F.coalesce(F.size("fused"), F.lit(0)) <= 0), "empty"))
    out = out.union(code(r.where(F.size("fused") != F.size(F.array_distinct("fused"))), "duplicate_refs"))
    facts = manifest.select("table_ref", F.col("ticker").alias("own_ticker"), F.col("report_year").alias("own_year"), F.col("scope").alias("own_scope"))
    refs = r.select("id", "tickers", "years", "scope", F.explode("fused").alias("table_ref")).join(facts, "table_ref", "left")
    out = out.union(code(refs.where("own_ticker is null"), "unknown_refs", F.col("table_ref")))
    outside = lambda xs, x: (F.coalesce(F.size(xs), F.lit(0)) > 0) & ~F.array_contains(xs, F.col(x))
    wrong = outside("tickers", "own_ticker") | outside("years", "own_year") | (F.col("scope").isNotNull() & ~F.array_contains(widened_scope(F.col("scope")), F.col("own_scope")))
    out = out.union(code(refs.where(F.col("own_ticker").isNotNull() & F.coalesce(wrong, F.lit(False))), "wrong_metadata", F.col("table_ref")))
    asked = routes(r.select(F.col("id").alias("qid"), "tickers", "years", "scope")).select(F.col("qid").alias("id"), "ticker", "year", "scope").withColumn("route", F.concat_ws("/", "ticker", F.col("year").cast("string")))
    can = _served(asked, facts, "left_semi")
    missed = _served(can, refs.where("own_ticker is not null"), "left_anti", ["id"])
    out = out.union(code(missed, "available_routes_missing", F.col("route")))
    if {"hybrid", "reranked", "reranker_scores"} <= set(r.columns):
        out = out.union(code(r.where(reranker_error().isNotNull()), "reranker_integrity", reranker_error()))
    return out


def unavailable_routes(retrieval: DataFrame, manifest: DataFrame) -> DataFrame:
    facts = manifest.select(F.col("ticker").alias("own_ticker"), F.col("report_year").alias("own_year"), F.col("scope").alias("own_scope")).distinct()
    asked = routes(retrieval.select(F.col("id").alias("qid"), "tickers", "years", "scope"))
    return _served(asked, facts, "left_anti").select(F.col("qid").alias("id"), "ticker", "year", "scope")


def reranker_error() -> Column:
    """What is wrong with ``reranked``, ``hybrid``, ``fused`` and ``reranker_scores``; null if nothing or no reranking."""
    refs, scores = F.col("reranker_scores.table_ref"), F.col("reranker_scores.score")
    repeated = lambda xs: F.size(xs) != F.size(F.array_distinct(xs))
    falling = F.forall(F.sequence(F.lit(1), F.size(scores)), lambda i: (i == F.size(scores)) | (F.get(scores, i - 1) >= F.get(scores, i)))
    return F.when(F.col("reranked").isNotNull(), (
        F.when(F.col("reranker_scores").isNull(), "scores are missing")
        .when(~F.col("fused").eqNullSafe(F.col("reranked")), "fused and reranked differ")
        .when(repeated("reranked") | (F.size(F.array_except("reranked", "hybrid")) > 0), "reranked is not drawn from hybrid")
        .when(repeated(refs) | (F.size(F.array_except("hybrid", refs)) > 0) | (F.size(F.array_except(refs, F.col("hybrid"))) > 0), "scores do not cover every hybrid ref")
        .when(F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))), "a score is not finite")
        .when((F.size(scores) > 0) & ~falling, "scores do not fall")
    ))


def taxonomy(found: DataFrame, examples: int = 100) -> DataFrame:
    """``code``, ``n`` and first ids of violations."""
    return _counted(found, "code", examples, "examples")


def _counted(rows: DataFrame, by: str, most: int, name: str) -> DataFrame:
    """Rows of each value and its first distinct ids; all but these leave before a value's ids are brought together."""
    first = rows.select(by, "id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("id")))).where(F.col("_n") <= most)
    firsts = first.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias(name)).withColumnRenamed(by, "_by")
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(firsts, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", name)


def unreachable(target: Column, units: Column) -> Column:
    """Whether no program over cells of these table units can give the target's dimension."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in TARGET_DIMENSION.items() for x in kv]), target)
    own = F.transform(units, dimension)
    pair = F.exists(own, lambda d: F.size(F.filter(own, lambda e: e == d)) >= 2)
    free = want.isNull() | want.isin("COUNT", "YEAR") | F.array_contains(own, "UNKNOWN")
    share = want.isin("PERCENT", "RATIO")
    return F.when(free, False).when(share, ~(F.array_contains(own, "PERCENT") | pair)).otherwise(~F.array_contains(own, want))


def feasibility(rows: DataFrame, token_budget: int) -> DataFrame:
    """Adds ``blockers`` to rows with ``target_unit``, ``tickers``, ``years`` and their candidates' ``have_tickers``, ``have_years``, ``units``."""
    one = lambda c: F.greatest(F.size(c), F.lit(1))
    cells = one("tickers") * one("years")
    tests = {
        "unsupported_target_unit": ~F.col("target_unit").isin(*TARGET_DIMENSION),
        "candidates_miss_required_ticker": F.size(F.array_except("tickers", "have_tickers")) > 0,
        "candidates_miss_required_year": F.size(F.array_except("years", covered_years(F.col("have_years")))) > 0,
        "no_candidate_carries_the_target_dimension": unreachable(F.col("target_unit"), F.col("units")),
        "cohort_wider_than_grammar": cells > MOST_CELLS,
        "program_longer_than_token_budget": cells * TOKENS_PER_CELL > token_budget,
    }
    return rows.withColumns({"cells_needed": cells, "blockers": F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))})


def blocker_counts(audited: DataFrame, ids: int = 40) -> DataFrame:
    flat = audited.select("id", F.explode("blockers").alias("blocker"))
    return _counted(flat, "blocker", ids, "ids")


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of change counts between runs over the same ids; other ids raise."""
    both = left.alias("l").join(right.alias("r"), "id", "full_outer")
    lost = F.col("l.answer").isNull() | F.col("r.answer").isNull()
    differs = lambda c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    flags = {
        "answers": F.when(lost, F.raise_error(F.concat(F.lit("id in one run only: "), F.col("id").cast("string"))).cast("boolean")).otherwise(~is_close(F.col("l.answer"), F.col("r.answer"), 1e-12, 1e-9)),
        "pandas_queries": differs("pandas_query"), "evidence": differs("evidence"), "relevant_tables": differs("relevant_tables"), "relevant_docs": differs("relevant_docs"),
    }
    marked = both.select("id", *[f.alias(n) for n, f in flags.items()])
    any_ = F.greatest(*[F.col(n) for n in flags])
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("id"))))
    return marked.agg(F.count("*").alias("questions"), *[F.count_if(n).alias(n) for n in flags], F.count_if(any_).alias("any"), ids(F.col("answers")).alias("answer_ids"), ids(any_).alias("any_ids"))


def run_summary(traces: DataFrame) -> DataFrame:
    """Rows, fallbacks and medians of a run; medians over nothing are null."""
    return traces.agg(F.count("*").alias("traces"), F.count_if("fallback").alias("fallbacks"), F.median("latency").alias("median_latency"), F.median("tokens").alias("median_tokens"))


def merge_shards(shards: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of disjoint shards in key order; a repeated key raises."""
    out = shards[0]
    for part in shards[1:]:
        out = out.unionByName(part)
    repeated = out.groupBy(key).count().where("count > 1").first()  # keys alone are counted
    if repeated is not None:
        raise ValueError(f"repeated: {repeated[key]}")
    return out.orderBy(key)


def check_fingerprints(prints: list[str], indexes: list[int]) -> None:
    """Shards of one run have one fingerprint and the indexes 0 to n - 1."""
    if len(set(prints)) != 1 or sorted(indexes) != list(range(len(prints))):
        raise ValueError(f"shards do not belong together: {sorted(set(prints))}, {sorted(indexes)}")


def merge_outputs(predictions: DataFrame, errors: DataFrame, traces: DataFrame) -> DataFrame:
    """``id``, ``code`` of rows that are both predicted and failed, or traced without a prediction or the other way."""
    held = [df.select("id", *[F.lit(i == k).alias(c) for k, c in enumerate("pet")]) for i, df in enumerate((predictions, errors, traces))]
    every = dealt(held[0].union(held[1]).union(held[2]), "id").groupBy("id").agg(*[F.max(c).alias(c) for c in "pet"])
    p, e, t = map(F.col, "pet")
    codes = F.array_compact(F.array(F.when(p & e, "BOTH"), F.when(p & ~t, "NO_TRACE"), F.when(t & ~p, "NO_PREDICTION")))
    return every.select("id", F.explode(codes).alias("code"))


def file_conflicts(files: DataFrame) -> DataFrame:
    """Names that several shards hold with different contents."""
    return files.groupBy("name").agg(F.countDistinct("sha").alias("n")).where("n > 1").select("name")


def overlay(baseline: DataFrame, variant: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """The baseline with the variant's rows; the variant must have the expected ids, all in the baseline."""
    ids = expected.select(key, F.lit(1).alias("e")).join(variant.select(key, F.lit(1).alias("v")), key, "full_outer").join(baseline.select(key, F.lit(1).alias("b")), key, "left")
    bad = ids.where("e is null or v is null or b is null")
    if not bad.isEmpty():
        raise ValueError("the variant's ids are not those expected")
    return baseline.join(variant.select(key), key, "left_anti").unionByName(variant).orderBy(key)


def largest_remainder(counts: DataFrame, size: int, key: str = "stratum", n: str = "n") -> DataFrame:
    """``size`` seats by Hamilton's method: floors, then the largest remainders, ties to larger counts.

    The window runs over one row per stratum, however large the strata are.
    """
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    if not 1 <= size <= total:
        raise ValueError(f"a size from 1 to {total} is expected")
    exact = F.lit(size) * F.col(n) / F.lit(total)
    out = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.desc(n), F.desc(key))
    out = out.withColumn("_place", F.row_number().over(order)).withColumn("_left", F.lit(size) - F.sum("_floor").over(Window.partitionBy()))
    return out.select(key, n, (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")).cast("int").alias("seats"))


def stratified_sample(rows: DataFrame, seats: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """Seats of each stratum filled in a seeded hash order, without replacement."""
    order = Window.partitionBy(stratum).orderBy(seeded(key, seed), key)
    return rows.join(F.broadcast(seats.select(stratum, "seats")), stratum).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("seats")).drop("_n", "seats")


def fan_out(n: Column) -> Column:
    """Stratum of a route count: 1 to 7, then 8+."""
    return F.when(n >= 8, "8+").otherwise(n.cast("string"))


def quota_sample(rows: DataFrame, weights: dict[str, float], count: int, key: str, family: str, seed: int) -> DataFrame:
    """round(count x weight), one at least, of each family."""
    quota = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, max(1, round(count * w)))])
    order = Window.partitionBy(family).orderBy(seeded(key, seed), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.try_element_at(quota, F.col(family))).drop("_n")


def decoding_report(measured: DataFrame) -> DataFrame:
    """Median rates of constrained and free decoding, their ratio and what it suggests."""
    rate = lambda mode: F.median(F.when(F.col("mode") == mode, F.col("rate")))
    ratio = F.col("free") / F.nullif(F.col("constrained"), F.lit(0.0))
    verdict = F.when(ratio.isNull(), "insufficient").when(ratio >= 1.5, "constrained decoding is a likely bottleneck").when(ratio <= 1.2, "constrained decoding is not the bottleneck").otherwise("mixed")
    return measured.agg(rate("json_schema").alias("constrained"), rate("unconstrained").alias("free")).withColumns({"ratio": ratio, "verdict": verdict})


def policy_projection(failures: DataFrame) -> DataFrame:
    """``policy``, ``family``, ``allowed``, ``forbidden``: failed programs (``target``, ``kind``, ``family``) by root policy."""
    from ..plans.wire import POLICIES

    spark = failures.sparkSession
    rules = spark.createDataFrame([(p, t, list(k)) for p, by in POLICIES.items() for t, k in by.items()], "policy string, target string, kinds array<string>")
    names = spark.createDataFrame([(p,) for p in POLICIES], "policy string")
    counts = failures.groupBy("target", "kind", "family").agg(F.count("*").alias("n"))  # a few rows before the product
    every = counts.crossJoin(F.broadcast(names)).join(F.broadcast(rules), ["policy", "target"], "left")
    allowed = F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return every.groupBy("policy", "family").agg(total(allowed).alias("allowed"), total(~allowed).alias("forbidden"))


def hit_counts(attempts: DataFrame) -> DataFrame:
    """``family``: questions, solved at the first attempt, solved at all, solved exactly once, from ``hits`` (array of 0/1)."""
    total = F.aggregate("hits", F.lit(0), lambda s, h: s + h.cast("int"))
    return attempts.groupBy("family").agg(
        F.count("*").alias("questions"), F.sum(F.coalesce(F.get("hits", F.lit(0)).cast("int"), F.lit(0))).alias("first"), F.count_if(total > 0).alias("solved"), F.count_if(total == 1).alias("once")
    )
