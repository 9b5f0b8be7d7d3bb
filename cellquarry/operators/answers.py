"""Answers: conventions, citations, reference grammars, fallbacks and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import fill
from ..functions.numbers import is_close
from ..functions.text import content_words
from ..functions.units import dimension
from ..sources.shared import dealt

# Phrases that ask for a difference without a direction.
UNDIRECTED = r"(?iuU)\b(chênh\s+lệch|khác\s+biệt|cách\s+biệt|chênh\s+nhau)\b"
# The ways a table's position is written behind its document.
GRAMMARS = ("table_n", "ordinal", "ordinal0", "table_n0", "line", "line0", "line1", "char", "page", "global")


def asks_undirected(question: Column) -> Column:
    return question.rlike(UNDIRECTED)


def unsigned_differences(answers: DataFrame) -> DataFrame:
    """Negative answers to undirected questions lose their sign, in ``answer`` and ``pandas_query``; ``changed`` tells."""
    change = F.coalesce((F.col("answer") < 0) & asks_undirected(F.col("question")) & (F.trim("pandas_query") != ""), F.lit(False))
    query = F.when(change, F.concat(F.lit("abs("), "pandas_query", F.lit(")"))).otherwise(F.col("pandas_query"))
    return answers.withColumns({"changed": change, "pandas_query": query, "answer": F.when(change, F.abs("answer")).otherwise(F.col("answer"))})


def document_of(ref: Column) -> Column:
    return F.substring_index(ref, "|", 1)


def routed_documents(specs: DataFrame, documents: DataFrame, policy: str) -> DataFrame:
    """``qid``, ``docs``: known reports that a question's tickers, years and scope name, in that order.

    An unstated scope is the policy's; ``both`` names the consolidated and the
    separate report.
    """
    assumed = F.array(*map(F.lit, ("consolidated", "separate") if policy == "both" else (policy,)))
    scopes = F.when(F.col("scope").isNotNull(), F.array("scope")).otherwise(assumed)
    named = specs.select("qid", F.posexplode("tickers").alias("i", "ticker"), "years", scopes.alias("scopes"))
    named = named.select("qid", "i", "ticker", F.posexplode("years").alias("j", "year"), "scopes").select("qid", "i", "j", "ticker", "year", F.posexplode("scopes").alias("k", "s"))
    named = named.withColumn("doc_id", F.concat_ws("_", "ticker", F.lit("financial_statements"), F.col("year").cast("string"), "s"))
    known = named.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    first = known.groupBy("qid", "doc_id").agg(F.min(F.struct("i", "j", "k")).alias("at"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))


def widen_citations(
    predictions: DataFrame, ranked: DataFrame, n_tables: int, table_routes: DataFrame | None = None, doc_routes: DataFrame | None = None, router_only: bool = False, doc_depth: int | None = None, doc_cap: int | None = None
) -> DataFrame:
    """Cited tables first, then ranked ones up to ``n_tables``; documents from tables, depth or routes.

    ``ranked`` has ``qid`` and ``refs`` (array).  With routes only tables of
    routed documents are cited; where that leaves none, the read tables stay.
    Tables that the program read are never cut.
    """
    out = predictions.join(ranked.select(F.col("qid").alias("id"), "refs"), "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    none = F.lit(None).cast("array<string>")
    for name, routes in (("_tables_in", table_routes), ("_docs_in", doc_routes)):
        out = out.withColumn(name, none) if routes is None else out.join(routes.select(F.col("qid").alias("id"), F.col("docs").alias(name)), "id", "left")
    inside = lambda refs: F.when(F.col("_tables_in").isNull(), refs).otherwise(F.filter(refs, lambda r: F.array_contains("_tables_in", document_of(r))))
    read = inside(F.col("relevant_tables"))
    cited = F.when(F.size(read) >= n_tables, read).otherwise(fill(read, inside(F.col("refs")), n_tables))
    cited = F.when(F.size(cited) == 0, F.col("relevant_tables")).otherwise(cited)
    out = out.withColumn("_cited", cited)
    sources = F.col("_cited") if doc_depth is None else F.when(F.size("_cited") >= doc_depth, F.col("_cited")).otherwise(fill(F.col("_cited"), F.col("refs"), doc_depth))
    docs = F.array_distinct(F.transform(sources, document_of))
    routed = F.col("_docs_in") if router_only else F.array_distinct(F.concat(docs, F.col("_docs_in")))
    docs = F.when(F.coalesce(F.size("_docs_in"), F.lit(0)) > 0, routed).otherwise(docs)
    docs = docs if doc_cap is None else F.slice(docs, 1, doc_cap)
    return out.withColumns({"relevant_docs": docs, "relevant_tables": F.col("_cited")}).drop("refs", "_tables_in", "_docs_in", "_cited")


def cite_candidates(candidates: DataFrame) -> DataFrame:
    """``id`` and the very tables that a prompt showed, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("n", "ref")))
    return candidates.groupBy(F.col("qid").alias("id")).agg(F.transform(pairs, lambda x: x["ref"]).alias("relevant_tables"))


def cite_routed(routes: DataFrame, manifest: DataFrame, fallback: DataFrame) -> DataFrame:
    """``id`` and every table of every routed document; without a route the fallback's ``refs``."""
    flat = routes.select("qid", F.posexplode("docs").alias("i", "doc_id")).join(manifest.select("doc_id", "table_id", "table_ref"), "doc_id")
    pairs = F.array_sort(F.collect_list(F.struct("i", "table_id", "table_ref")))
    cited = flat.groupBy("qid").agg(F.transform(pairs, lambda x: x["table_ref"]).alias("cited"))
    return fallback.join(cited, "qid", "left").select(F.col("qid").alias("id"), F.coalesce("cited", "refs").alias("relevant_tables"))


def retarget(refs: DataFrame, grammar: str, manifest: DataFrame | None = None) -> DataFrame:
    """Adds ``target``: ``table_ref`` rewritten in a grammar.  A reference of another form, or without the position, raises."""
    if grammar not in GRAMMARS:
        raise ValueError(f"no such grammar: {grammar}")
    doc, number = F.regexp_extract("table_ref", r"^(.+)\|table_(\d+)$", 1), F.regexp_extract("table_ref", r"^(.+)\|table_(\d+)$", 2).try_cast("int")
    out = refs
    if grammar in ("line", "line0", "line1", "char", "page", "global"):
        from .ranking import global_index

        facts = manifest.select("table_ref", "doc_id", "table_id", "line_no", "char_offset", "page_no")
        if grammar == "global":
            facts = global_index(facts, "doc_id", "table_id")
        wanted = {
            "line": F.col("line_no"), "line0": F.col("line_no") - 1, "line1": F.col("line_no") + 1, "char": F.col("char_offset"),
            "page": F.coalesce("page_no", F.lit(-1)), "global": F.col("index") + 1 if grammar == "global" else None,
        }[grammar]
        out = out.join(facts.select("table_ref", wanted.cast("string").alias("_at")), "table_ref", "left")
    else:
        at = {"table_n": F.concat(F.lit("table_"), number.cast("string")), "ordinal": number.cast("string"), "ordinal0": (number - 1).cast("string"), "table_n0": F.concat(F.lit("table_"), (number - 1).cast("string"))}
        out = out.withColumn("_at", at[grammar])
    bad = F.raise_error(F.concat(F.lit("no position: "), "table_ref")).cast("string")
    return out.withColumn("target", F.when((doc != "") & F.col("_at").isNotNull(), F.concat(doc, F.lit("|"), "_at")).otherwise(bad)).drop("_at")


def finalize(predictions: DataFrame, ranked: DataFrame, specs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The fixed profile: unsigned differences, five routed tables, routed documents only, line grammar."""
    routes = routed_documents(specs, manifest, "consolidated")
    out = widen_citations(unsigned_differences(predictions), ranked, 5, table_routes=routes, doc_routes=routes, router_only=True)
    flat = out.select("id", F.posexplode("relevant_tables").alias("i", "table_ref"))
    flat = retarget(flat, "line", manifest).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "target"))), lambda x: x["target"]).alias("_tables"))
    return out.join(flat, "id").withColumn("relevant_tables", F.col("_tables")).drop("_tables")


def best_cells(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """The cell whose labels fit a question best: ``qid``, ``variable``, ``row_index``, ``column_index``, ``score``.

    ``cells`` has ``qid`` and ``variable``; ``questions`` ``question`` and
    ``years``.  Shared content words count 2 each, a wanted year in the column 3;
    of equal cells the first by table, row and column is taken.
    """
    asked = questions.select("qid", content_words(F.col("question")).alias("words"), F.transform("years", lambda y: y.cast("string")).alias("wanted"))
    scored = dealt(cells.where("numeric_value is not null"), "qid").join(asked, "qid")
    year = F.exists("wanted", lambda y: F.contains(F.col("column_label"), y))
    scored = scored.withColumn("score", 2 * F.size(F.array_intersect("words", content_words(F.col("row_label")))) + F.when(year, 3).otherwise(0))
    number = F.regexp_extract("variable", r"(\d+)$", 1).cast("int")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), number, "row_index", "column_index")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "words", "wanted")


def fallback_answers(best: DataFrame, divisors: DataFrame) -> DataFrame:
    """``qid``, ``answer`` of the best cell in the wanted unit; shares of a whole stay as they are written."""
    value = F.when(dimension(F.col("source_unit")) == "PERCENT", F.col("numeric_value")).otherwise(F.col("base_value"))
    return best.join(divisors, "qid").select("qid", F.try_divide(value, F.col("target_divisor")).alias("answer"))


def violations(predictions: DataFrame, allow_partial_docs: bool = False) -> DataFrame:
    """``id``, ``code`` of every rule that a prediction breaks; none for a valid one."""
    variables = F.col("evidence.variable")
    blank = lambda xs: F.exists(xs, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    repeated = lambda xs: F.size(xs) != F.size(F.array_distinct(xs))
    parts = lambda p: F.split(p, "/")
    unsafe = lambda p: (
        F.contains(p, F.lit("\\")) | p.startswith("/") | (F.get(parts(p), F.lit(0)) != "data") | F.array_contains(parts(p), "..") | ~F.lower(p).endswith(".csv")
    )
    rules = {
        "ANSWER": F.col("answer").isNull() | F.isnan("answer") | (F.abs("answer") == float("inf")),
        "QUERY": F.coalesce(F.trim("pandas_query"), F.lit("")) == "",
        "DOCS": (F.coalesce(F.size("relevant_docs"), F.lit(-1)) <= 0) | blank("relevant_docs") | repeated("relevant_docs"),
        "TABLES": (F.coalesce(F.size("relevant_tables"), F.lit(-1)) <= 0) | blank("relevant_tables") | repeated("relevant_tables"),
        "TABLE_FORM": F.exists("relevant_tables", lambda r: ~r.rlike(r"^[^|]+\|.+")),
        "VARIABLES": (F.coalesce(F.size("evidence"), F.lit(-1)) <= 0) | repeated(variables) | F.exists(variables, lambda v: ~v.rlike("^[A-Za-z_][A-Za-z0-9_]*$")),
        "CSV_PATH": F.exists(F.col("evidence.csv_path"), unsafe),
    }
    if not allow_partial_docs:
        rules["DOC_COVERAGE"] = F.exists("relevant_tables", lambda r: ~F.array_contains("relevant_docs", document_of(r)))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), code) for code, test in rules.items()]))
    return predictions.select("id", F.explode(broken).alias("code"))


def reconcile(predictions: DataFrame, questions: DataFrame, executed: DataFrame) -> DataFrame:
    """``id``, ``code``: rows that are missing, extra, of another question, or whose re-execution differs."""
    both = predictions.select("id", F.col("question").alias("given"), "answer", F.lit(1).alias("p")).join(questions.select("id", "question", F.lit(1).alias("q")), "id", "full_outer")
    both = both.join(executed.select("id", F.col("answer").alias("again")), "id", "left")
    code = (
        F.when(F.col("p").isNull(), "MISSING").when(F.col("q").isNull(), "EXTRA").when(~F.col("given").eqNullSafe(F.col("question")), "QUESTION")
        .when(F.col("again").isNull() | ~is_close(F.col("answer"), F.col("again"), 1e-9, 0.01), "ANSWER")
    )
    return both.select("id", code.alias("code")).where("code is not null")


def reusable(now: DataFrame, validated: DataFrame) -> DataFrame:
    """``id`` of predictions whose question, answer, query and evidence are those already validated."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("question", "answer", "pandas_query", "evidence")]
    return now.alias("n").join(validated.alias("v"), [F.col("n.id") == F.col("v.id"), *same]).select("n.id")
