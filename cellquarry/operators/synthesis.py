"""Synthetic questions with known programs, drawn as set operations over cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_compact, fold_label_native
from ..functions.units import dimension

# Limits and label marks that make a cell fit to be asked about, and the mix of families.
LEAST_LABEL, LEAST_DENOMINATOR, MOST_PERCENT, MOST_VALUE = 12, 1e9, 500.0, 1e16
SUBITEM_MARKS = ("-", "+", "*", "•", "–", "(")
ROLLFORWARD = ("số dư", "số cuối", "số đầu", "tại ngày", "cộng", "tổng cộng phát sinh")
#: A label that begins with a mark; a folded one that is not empty, begins with no digit and names no rollforward.
_MARKED = f"^[{''.join(map(re.escape, SUBITEM_MARKS))}]"
_ITEM = f"(?s)^(?![0-9])(?!.*(?:{'|'.join(ROLLFORWARD)}))."
FAMILY_WEIGHTS = {"lookup": 0.357, "ratio": 0.116, "change": 0.116, "extremum": 0.198, "conditional": 0.213}


def usable_tables(manifest: DataFrame) -> DataFrame:
    return manifest.where("unit <> 'UNKNOWN' and n_rows >= 3 and n_cols >= 2 and scope in ('consolidated', 'separate')")


def askable(label: Column) -> Column:
    """Whether a label names one line item by itself."""
    own, folded = F.trim(label), fold_label_native(label)
    return (F.length(own) >= LEAST_LABEL) & ~own.rlike(_MARKED) & folded.rlike(_ITEM)  # one test, as each would fold the label anew


def askable_cells(cells: DataFrame) -> DataFrame:
    """Numbers under askable labels in the leftmost column that names the report year."""
    fit = cells.where((F.col("column_index") > 0) & (F.abs("base_value") > 0) & (F.abs("base_value") <= MOST_VALUE) & askable(F.col("row_label")))
    fit = fit.where(F.contains("column_label", F.col("report_year").cast("string")))
    left = F.min("column_index").over(Window.partitionBy("table_ref"))
    return fit.withColumn("_left", left).where("column_index = _left").drop("_left")


def _ref(row: str = "", variable: str = "df1") -> Column:
    return F.struct(F.lit(variable).alias("variable"), F.col(f"{row}row_index").alias("row_index"), F.col(f"{row}column_index").alias("column_index"))


def lookups(cells: DataFrame) -> DataFrame:
    """One cell with a known unit: ``table_ref``, ``row_label``, ``cell``, ``answer``."""
    known = dimension(F.col("source_unit")) != "UNKNOWN"
    value = F.when(dimension(F.col("source_unit")) == "PERCENT", F.col("numeric_value")).otherwise(F.col("base_value"))
    return askable_cells(cells).where(known).select("table_ref", "row_label", _ref().alias("cell"), value.alias("answer"))


def ratios(cells: DataFrame) -> DataFrame:
    """Every line item as a percentage of the largest of its table, if that is large enough."""
    fit = askable_cells(cells).where(dimension(F.col("source_unit")) != "UNKNOWN").withColumns({"dim": dimension(F.col("source_unit")), "folded": fold_label_native(F.col("row_label"))})
    named = [F.col("row_label").alias("label"), F.col("folded").alias("folded"), F.col("dim").alias("dim")]
    largest = F.max(F.struct(F.abs("base_value").alias("size"), (-F.col("row_index")).alias("at"), F.col("base_value").alias("value"), *named))
    out = fit.withColumn("den", largest.over(Window.partitionBy("table_ref", "column_index")))
    out = out.where((F.col("den.size") >= LEAST_DENOMINATOR) & (F.col("folded") != F.col("den.folded")) & (F.col("dim") == F.col("den.dim")))
    out = out.withColumn("answer", F.try_divide("base_value", F.col("den.value")) * 100).where((F.abs("answer") <= MOST_PERCENT) & (F.col("answer") != 0))
    return out.select("table_ref", "row_index", "column_index", "row_label", F.col("den.label").alias("of_label"), "answer")


def yearly(cells: DataFrame) -> DataFrame:
    """One value per company, scope, folded label and year, with how many cells compete."""
    fit = askable_cells(cells).withColumn("label", fold_label_native(F.col("row_label")))
    keys = ["ticker", "scope", "label", "report_year"]
    first = F.min(F.struct("table_ref", "row_index", "base_value", "source_unit")).alias("c")
    return fit.groupBy(*keys).agg(first, F.count("*").alias("cells")).select(*keys, "cells", "c.*")


def changes(series: DataFrame) -> DataFrame:
    """Percentage change to the next year on record."""
    order = Window.partitionBy("ticker", "scope", "label").orderBy("report_year")
    out = series.withColumns({"earlier": F.lag("base_value").over(order), "from_year": F.lag("report_year").over(order)})
    out = out.where((F.abs("earlier") >= LEAST_DENOMINATOR) & (dimension(F.col("source_unit")) != "UNKNOWN"))
    out = out.withColumn("answer", (F.col("base_value") - F.col("earlier")) / F.col("earlier") * 100)
    return out.where(F.abs("answer") <= MOST_PERCENT).select("ticker", "scope", "label", "from_year", "report_year", "answer")


def extrema(series: DataFrame, mode: str = "argmax") -> DataFrame:
    """The year of the extreme of a line item over 3 to 5 years; the first of equal years."""
    sign = 1 if mode == "argmin" else -1
    best = F.min(F.struct((sign * F.col("base_value")).alias("k"), F.col("report_year").alias("y")))
    out = series.groupBy("ticker", "scope", "label").agg(F.count("*").alias("years"), best["y"].alias("answer"))
    return out.where("years between 3 and 5")


def conditionals(pairs: DataFrame) -> DataFrame:
    """Of ``gate`` and ``value`` series (one row per ``key`` and ``year``): the best value among years above an order statistic of the gate.

    Kept only if two years or more pass and the filter changes the answer.
    """
    rows = F.array_sort(F.collect_list(F.struct("year", "gate", "value")))
    out = pairs.groupBy("key").agg(rows.alias("rows")).where(F.size("rows") >= 3)
    gates = F.array_sort(F.transform("rows", lambda r: r["gate"]))
    out = out.withColumn("threshold", F.get(gates, F.greatest(F.lit(0), F.floor(F.size("rows") / 2).cast("int") - 1)))
    kept = F.filter("rows", lambda r: r["gate"] > F.col("threshold"))
    best = lambda xs: F.array_min(F.transform(xs, lambda r: F.struct((-r["value"]).alias("k"), r["year"].alias("y"), r["value"].alias("v"))))
    out = out.withColumns({"top_n": F.size(kept), "of_years": F.size("rows"), "chosen": best(kept), "plain": best(F.col("rows"))})
    return out.where((F.col("top_n") >= 2) & (F.col("chosen.y") != F.col("plain.y"))).select("key", "threshold", "top_n", "of_years", F.col("chosen.v").alias("answer"))


def acceptable(unit: Column, answer: Column, cells: Column) -> Column:
    """Finite, no absurd percentage, and not several cells cancelled to zero."""
    finite = answer.isNotNull() & ~F.isnan(answer) & (F.abs(answer) != float("inf"))
    return finite & ~((unit == "PERCENT") & (F.abs(answer) > MOST_PERCENT)) & ~((answer == 0) & (cells > 1))


def recover_conditions(gates: DataFrame) -> DataFrame:
    """``id``, ``row_label``, ``top_n``, ``of_years`` of gate cells (``id``, ``row_label``, ``base_value``, ``threshold``).

    Labels must agree when folded, every cell hold a number and two at least
    pass; other ids are left out.
    """
    tidy = F.min(F.struct(F.length("row_label").alias("n"), F.col("row_label").alias("label")))
    out = gates.groupBy("id").agg(
        tidy["label"].alias("row_label"), F.countDistinct(ascii_compact(F.col("row_label"))).alias("labels"), F.count_if(F.col("base_value") > F.col("threshold")).alias("top_n"),
        F.count("*").alias("of_years"), F.count_if(F.col("base_value").isNull()).alias("blank"),
    )
    return out.where("labels = 1 and top_n >= 2 and blank = 0").select("id", "row_label", F.col("top_n").cast("int"), F.col("of_years").cast("int"))


def shared_in_all(series: DataFrame, years: int) -> DataFrame:
    """Labels that a company's statements hold in every one of ``years`` years (relational division)."""
    return series.groupBy("ticker", "scope", "label").agg(F.countDistinct("report_year").alias("n")).where(F.col("n") == years).select("ticker", "scope", "label")


def label_index(series: DataFrame) -> DataFrame:
    """label to years and tables."""
    return series.groupBy("ticker", "scope", "label", "report_year").agg(F.array_sort(F.collect_set("table_ref")).alias("refs"))


def rendering_prompt(name: Column, label: Column, year: Column, unit: Column, section: Column) -> Column:
    """The request to phrase one sample as a question."""
    where = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" (mục: "), section, F.lit(")")))
    return F.concat(F.lit("Viết một câu hỏi về khoản mục \""), label, F.lit("\""), F.coalesce(where, F.lit("")), F.lit(" của "), name, F.lit(" năm "), year.cast("string"), F.lit(", đơn vị "), unit, F.lit("."))
