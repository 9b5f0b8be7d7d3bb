"""Sources and sinks.

Readers declare their schemas and never infer them.  Files written by the driver
alone (single JSON reports, packages) go through a temporary name and a rename.
"""

from __future__ import annotations

import json
import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_compact, squash
from ..operators.tables import CELL_COLUMNS, PARSED, STRUCTURE, parse_cells, parse_reports

MANIFEST = (
    "table_ref string, doc_id string, ticker string, report_year int, scope string, table_id int, page_no int, line_no int, char_offset int, "
    "section_title string, unit string, header_rows int, n_rows int, n_cols int, headers array<string>, row_labels array<string>, "
    "retrieval_text string, source_path string, html_sha256 string, identity_status string"
)
CELLS = (
    "table_ref string, doc_id string, ticker string, report_year int, scope string, source_unit string, row_index int, column_index int, "
    "row_label string, column_label string, raw_value string, numeric_value double, base_value double, is_dash boolean, is_missing boolean"
)
QUESTIONS = "id long, question string"
RETRIEVAL = (
    "id long, question string, query_spec struct<tickers: array<string>, years: array<int>, scope: string, target_unit: string, target_divisor: double>, "
    "bm25 array<string>, dense array<string>, hybrid array<string>, fused array<string>, reranked array<string>, "
    "reranker_scores array<struct<table_ref: string, score: double>>"
)
PREDICTIONS = (
    "id long, question string, answer double, relevant_docs array<string>, relevant_tables array<string>, "
    "evidence array<struct<variable: string, csv_path: string>>, pandas_query string"
)


def scope_of(doc_id: Column) -> Column:
    """The kind of statement a document's name gives away; the first that fits."""
    compact = ascii_compact(doc_id)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(compact, w))
    return (
        F.when(has("consolidated", "hopnhat"), "consolidated")
        .when(has("separate", "rieng", "congtyme"), "separate")
        .when(has("aggregated", "tonghop"), "aggregated")
        .otherwise("unknown")
    )


def fiscal_year_end(text: Column) -> Column:
    """The first "ended on" date of the first 50,000 characters, as written; null if absent."""
    head = squash(F.substring(text, 1, 50_000))
    return F.nullif(F.regexp_extract(head, r"(?iu)(?:kết thúc|ket thuc)(?: vào)? ngày (\d{1,2}[./-]\d{1,2}[./-]\d{4})", 1), F.lit(""))


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """``ticker``, ``year``, ``doc_id`` and ``scope`` from .../TICKER/YEAR/DOCUMENT/file; ``path_ok`` tells bad layouts."""
    parts = F.split(path, "/")
    at = lambda n: F.try_element_at(parts, F.lit(n))
    out = df.withColumns({"ticker": F.upper(at(-4)), "year": at(-3).try_cast("int"), "doc_id": at(-2)})
    out = out.withColumn("path_ok", (F.size(parts) >= 4) & at(-3).rlike("^[0-9]+$") & F.col("year").isNotNull())
    return out.withColumn("scope", scope_of(F.col("doc_id")))


def read_reports(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Whole report files; invalid bytes become replacement characters.

    Files whose path does not have the layout raise when ``strict``, else they
    stay with ``path_ok`` false.
    """
    raw = spark.read.text(f"{root}/*/*/*/*.txt", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    out = path_parts(raw).withColumn("fiscal_year_end", fiscal_year_end(F.col("text")))
    if strict:
        message = F.concat(F.lit("not TICKER/YEAR/DOCUMENT/file: "), "path")
        out = out.withColumn("text", F.when(F.col("path_ok"), F.col("text")).otherwise(F.raise_error(message).cast("string")))
    return out


def read_tables(reports: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Parsed tables of reports with their keys and structure; ``columns`` names what is wanted beside the keys."""
    keep = ["ticker", "year", "doc_id", "scope", "path"]
    columns = [c.split()[0] for c in f"{PARSED}, {STRUCTURE}".split(", ")] if columns is None else columns
    tables = parse_reports(reports, keep, ["table_id", *(c for c in columns if c != "table_id")])
    ref = F.concat("doc_id", F.lit("|table_"), F.col("table_id").cast("string"))
    return tables.withColumnRenamed("year", "report_year").withColumnRenamed("path", "source_path").withColumn("table_ref", ref)


def read_cells(reports: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The cells of all tables of reports; ``columns`` names those wanted."""
    return parse_cells(reports, columns)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """``ticker``, ``name`` from the first two columns, whatever they are called."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    if len(raw.columns) < 2:
        raise ValueError(f"two columns are needed: {path}")
    ticker, name = raw.columns[:2]
    clean = lambda c: F.trim(F.replace(F.col(f"`{c}`"), F.lit("﻿"), F.lit("")))
    return raw.select(F.upper(clean(ticker)).alias("ticker"), clean(name).alias("name"))


def read_cells_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELLS).csv(path, header=True, escape='"', multiLine=True)


def write_cells_csv(cells: DataFrame, path: str, by: list[str]) -> None:
    cells.write.partitionBy(*by).csv(path, header=True, escape='"', mode="overwrite")


def lookup(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    """Manifest rows of ``refs.table_ref``; a reference that is missing raises."""
    found = refs.select("table_ref").distinct().join(manifest, "table_ref", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit("no such table: "), "table_ref")).cast("string"))
    return found.withColumn("doc_id", known)


def missing_refs(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.select("table_ref").distinct().join(manifest, "table_ref", "left_anti")


def drifted(manifest: DataFrame, tables: DataFrame) -> DataFrame:
    """References whose markup no longer has the hash in the manifest."""
    now = tables.select("table_ref", F.sha2("html", 256).alias("now"))
    return manifest.join(now, "table_ref").where("now <> html_sha256").select("table_ref")


def point_cells(cells: DataFrame, manifest: DataFrame, refs: DataFrame, unit_source: str = "latest") -> DataFrame:
    """Cells of the wanted tables; ``manifest`` as unit source restores the frozen table unit where cells name none."""
    if unit_source not in ("latest", "manifest"):
        raise ValueError(f"no such unit source: {unit_source}")
    out = cells.join(refs.select("table_ref").distinct(), "table_ref", "left_semi")
    if unit_source == "manifest":
        from ..functions.units import cell_unit, to_base

        out = out.join(manifest.select("table_ref", F.col("unit").alias("_unit")), "table_ref")
        out = out.withColumn("source_unit", cell_unit(F.col("_unit"), F.col("row_label"), F.col("column_label")))
        out = out.withColumn("base_value", to_base(F.col("numeric_value"), F.col("source_unit")))
    return out.select(*CELL_COLUMNS)


def write_json(path: str | Path, value: object) -> None:
    """One JSON file that is there whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
    os.replace(part, path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: str = MANIFEST) -> None:
    read_jsonl(spark, source, schema).write.mode("overwrite").option("compression", "zstd").parquet(target)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("ticker", "report_year")) -> None:
    """Parquet by partition columns, rows of one folder together so that files stay few."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


def write_package(predictions: list[dict], root: str | Path, target: str | Path) -> list[str]:
    """A ZIP of ``submission.json`` and each cited CSV once; refuses to overwrite."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    cited = sorted({e["csv_path"] for p in predictions for e in p["evidence"]})
    part = target.with_name(f".{target.name}.part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        z.writestr("submission.json", json.dumps(predictions, ensure_ascii=False))
        for name in cited:
            z.write(Path(root) / name, name)
    os.replace(part, target)
    return ["submission.json", *cited]


def restore_evidence(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of every cited table by ``id`` and ``variable``; evidence and tables pair by position."""
    pairs = F.when(
        F.size("evidence") == F.size("relevant_tables"), F.arrays_zip(F.col("evidence.variable").alias("variable"), F.col("evidence.csv_path").alias("csv_path"), F.col("relevant_tables").alias("table_ref"))
    ).otherwise(F.raise_error(F.concat(F.lit("evidence and tables differ in number: "), F.col("id").cast("string"))))
    flat = predictions.select("id", F.inline(pairs))
    return flat.join(cells, "table_ref")


def archive_run(traces: DataFrame, scores_text: str, n_scores: int = 10) -> DataFrame:
    """Counts of a run's outcomes next to its scores; exactly ``n_scores`` decimals are expected."""
    scores = [float(x) for x in re.findall(r"\d+\.\d+", scores_text)]
    if len(scores) != n_scores:
        raise ValueError(f"{n_scores} scores are expected, {len(scores)} found")
    totals = traces.agg(
        F.count_if((F.col("rescue").isNull()) & ~F.col("fallback")).alias("clean"), F.count_if(F.col("rescue").isNotNull()).alias("rescued"), F.count_if("fallback").alias("fallback")
    )
    return totals.withColumns({f"score_{i}": F.lit(x) for i, x in enumerate(scores, 1)})


def find_inputs(root: str | Path, name: str, depth: int = 4) -> list[Path]:
    """Files of a name below ``root``, through links, cycles visited once (a driver utility)."""
    found, seen, queue = [], set(), [(Path(root), 0)]
    while queue:
        folder, level = queue.pop()
        real = folder.resolve()
        if real in seen or not folder.is_dir():
            continue
        seen.add(real)
        for entry in sorted(folder.iterdir()):
            if entry.is_dir() and level < depth:
                queue.append((entry, level + 1))
            elif entry.name == name:
                found.append(entry)
    return sorted(found)
