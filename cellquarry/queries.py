"""Queries over the driver's tables, each with DuckDB SQL of the same meaning.

The tables hold no reports, so inputs (markup, labels, rankings, programs) are
derived from their columns inside the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, text, units
from .functions.arrays import covered_years, fill
from .operators import answers, control, quality, questions, ranking, search, synthesis, tables
from .plans import nodes
from .plans.bind import FACT, run_batch
from .plans.evaluate import to_column
from .plans.interchange import text_to_column, to_text
from .sources.shared import new_path, stored
from .streaming.ingest import KeyedTable, run_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- numbers, text, units -------------------------------------------------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE l_linenumber % 5 WHEN 1 THEN -round(l_extendedprice, 2) WHEN 3 THEN 0.0 ELSE round(l_extendedprice, 2) END AS value,
           l_linenumber % 5 = 3 AS is_dash, l_linenumber % 5 = 2 AS is_percent, false AS is_missing
    FROM lineitem
""")
def number_parsing(spark, sf):
    """Prices written the Vietnamese way, bracketed, as percentages, dashes and amounts, read back."""
    written = F.translate(F.format_number(F.round("l_extendedprice", 2), 2), ",.", ".,")
    kind = F.col("l_linenumber") % 5
    raw = F.when(kind == 1, F.concat(F.lit("("), written, F.lit(")"))).when(kind == 2, F.concat(written, F.lit("%"))).when(kind == 3, "–").when(kind == 4, F.concat(written, F.lit(" đồng"))).otherwise(F.concat(F.lit("  "), written))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_number(raw).alias("n"))
    return rows.select("l_orderkey", "l_linenumber", F.round("n.value", 2).alias("value"), "n.is_dash", "n.is_percent", "n.is_missing")


@query("""
    SELECT doc_id, md5(regexp_replace(t, '[^a-z0-9]+', '', 'g')) AS compact_md5,
           CAST(len(list_distinct(list_filter(string_split(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains(
             string_split('la bao nhieu cua nam cong ty co phan va trong theo duoc doanh nghiep tai gia tri tong so cac cho tu den moi', ' '), w)))) AS INTEGER) AS content_words
    FROM (SELECT doc_id, lower(replace(replace(strip_accents(text), 'ß', 'ss'), 'œ', 'oe')) AS t FROM documents)
""")
def accent_free_text(spark, sf):
    """Accent-free compact form and distinct content words of whole documents."""
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(text.ascii_compact(t).cast("binary")).alias("compact_md5"), F.size(text.content_words(t)).alias("content_words"))


@query("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'MILLION_VND' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'PERCENT' WHEN '4-NOT SPECIFIED' THEN 'SHARES' ELSE 'BILLION_VND' END AS unit,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'VND' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'PERCENT' WHEN '4-NOT SPECIFIED' THEN 'SHARES' ELSE 'VND' END AS dimension,
           round(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1e6 WHEN '5-LOW' THEN 1e9 ELSE 1 END, 0) AS base_value
    FROM orders
""")
def unit_resolution(spark, sf):
    """A cell's unit from its column, then its row, then its table; values in base units."""
    p = F.col("o_orderpriority")
    column = F.when(p == "1-URGENT", "Năm 2024 (triệu đồng)").when(p == "3-MEDIUM", "Tỷ lệ").otherwise("Năm 2024")
    row = F.when(p == "2-HIGH", 'US Dollar ("USD")').when(p == "4-NOT SPECIFIED", "Số cổ phần").otherwise("Doanh thu")
    unit = units.cell_unit(F.lit("BILLION_VND"), row, column)
    out = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", unit.alias("unit"))
    return out.select("o_orderkey", "unit", units.dimension(F.col("unit")).alias("dimension"), F.round(units.to_base(F.col("o_totalprice"), F.col("unit")), 0).alias("base_value"))


@query("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'MILLION_VND' WHEN '2-HIGH' THEN 'YEAR' WHEN '3-MEDIUM' THEN 'PERCENT' WHEN '4-NOT SPECIFIED' THEN 'COUNT' ELSE 'TRILLION_VND' END AS target_unit,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1e6 WHEN '5-LOW' THEN 1e12 ELSE 1.0 END AS target_divisor,
           CASE o_orderpriority WHEN '2-HIGH' THEN 'consolidated' WHEN '3-MEDIUM' THEN 'separate' END AS scope,
           [CAST(greatest(2015, least(2026, year(o_orderdate) + 23)) AS INTEGER)] AS years
    FROM orders
""")
def question_reading(spark, sf):
    """Target unit, divisor, scope and years of derived questions."""
    p, y = F.col("o_orderpriority"), F.least(F.lit(2026), F.greatest(F.lit(2015), F.year("o_orderdate") + 23)).cast("string")
    asked = (
        F.when(p == "1-URGENT", F.concat(F.lit("Doanh thu năm "), y, F.lit(" là bao nhiêu triệu đồng?"))).when(p == "2-HIGH", F.concat(F.lit("Theo báo cáo hợp nhất đến "), y, F.lit(", năm nào lãi nhất?")))
        .when(p == "3-MEDIUM", F.concat(F.lit("Công ty mẹ tăng bao nhiêu phần trăm trong năm "), y)).when(p == "4-NOT SPECIFIED", F.concat(F.lit("Có bao nhiêu công ty có lãi năm "), y, F.lit("?")))
        .otherwise(F.concat(F.lit("Tổng tài sản cuối năm "), y, F.lit(" là bao nhiêu nghìn tỷ đồng?")))
    )
    target = units.detect_target(F.col("q"))
    out = read(spark, sf, "orders").select("o_orderkey", asked.alias("q"))
    return out.select("o_orderkey", target["unit"].alias("target_unit"), target["divisor"].alias("target_divisor"), questions.scope_intent(F.col("q")).alias("scope"), F.array_distinct(questions.periods(F.col("q"))["year"]).alias("years"))


@query("""
    SELECT o_custkey, CAST(list_sort(list_distinct(list(CAST(year(o_orderdate) AS INTEGER)))) AS INTEGER[]) AS years,
           CAST(list_sort(list_distinct(flatten(list([CAST(year(o_orderdate) AS INTEGER), CAST(year(o_orderdate) - 1 AS INTEGER)])))) AS INTEGER[]) AS covered,
           list_sort(list(DISTINCT o_orderpriority))[1:2] AS firsts
    FROM orders GROUP BY o_custkey
""")
def array_idioms(spark, sf):
    """Distinct years, the years they cover, and a filled prefix."""
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return g.select("o_custkey", "years", covered_years(F.col("years")).alias("covered"), fill(F.slice("p", 1, 1), F.col("p"), 2).alias("firsts"))


# --- reports, tables, cells -----------------------------------------------------------------------------------------


def order_reports(spark, sf) -> DataFrame:
    """A report per order: a page mark, a declared unit, a section and one table with spanned headers."""
    quantity = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("</td><td>("))
    line = lambda r: F.concat(F.lit("<tr><td>Part "), r["l_partkey"].cast("string"), F.lit("</td><td>"), r["q"], r["l_linenumber"].cast("string"), F.lit(")</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", quantity.alias("q")))), line), "")
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(body.alias("body"))
    head = "===== PAGE 7 =====\nĐơn vị tính: triệu đồng\n1. Chi tiết\n<table><tr><td rowspan=2>Chỉ tiêu</td><td colspan=2>Kỳ</td></tr><tr><td>Số lượng</td><td>Dòng</td></tr>"
    markup = F.concat(F.lit(head), "body", F.lit("</table>"))
    return rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("T").alias("ticker"), F.lit(2024).alias("year"), F.lit("separate").alias("scope"), F.lit("x").alias("path"), markup.alias("text"))


def order_tables(spark, sf, columns: list[str] | None = None) -> DataFrame:
    from .sources.io import read_tables

    return read_tables(order_reports(spark, sf), columns)


def report_cells_of(spark, sf, columns: list[str]) -> DataFrame:
    from .sources.io import read_cells

    return read_cells(order_reports(spark, sf), columns)


@query("""
    WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '<') - 1 AS INTEGER) AS row_index FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) || '|table_1' AS table_ref, row_index, c AS column_index, 'Part ' || l_partkey AS row_label,
           CASE c WHEN 0 THEN 'Chỉ tiêu' WHEN 1 THEN 'Kỳ | Số lượng' ELSE 'Kỳ | Dòng' END AS column_label,
           CASE c WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) WHEN 2 THEN -CAST(l_linenumber AS DOUBLE) END AS numeric_value,
           1e6 * CASE c WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) WHEN 2 THEN -CAST(l_linenumber AS DOUBLE) END AS base_value,
           'MILLION_VND' AS source_unit
    FROM r CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS c)
""")
def report_cells(spark, sf):
    """Markup of every order parsed back into the cell relation."""
    return report_cells_of(spark, sf, ["table_ref", "row_index", "column_index", "row_label", "column_label", "numeric_value", "base_value", "source_unit"])


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) || '|table_1' AS table_ref, 7 AS page_no, 4 AS line_no, '1. Chi tiết' AS section_title, 'MILLION_VND' AS unit, 2 AS header_rows,
           CAST(count(*) AS INTEGER) AS n_rows, 3 AS n_cols, CAST(count(DISTINCT l_partkey) AS INTEGER) AS n_labels
    FROM lineitem GROUP BY l_orderkey
""")
def report_manifest(spark, sf):
    """One manifest row per table."""
    m = tables.to_manifest(order_tables(spark, sf, tables.FOR_MANIFEST))
    return m.select("table_ref", "page_no", "line_no", "section_title", "unit", "header_rows", "n_rows", "n_cols", F.size("row_labels").alias("n_labels"))


@query("""
    SELECT user_id, event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events)
""")
def carried_values(spark, sf):
    """The last value known, carried forward over clicks."""
    e = read(spark, sf, "events").withColumn("value", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")))
    return tables.carry_forward(e, "value", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""
    SELECT o.o_orderkey, o.o_custkey, max(e.d) AS last_day
    FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) o
    LEFT JOIN (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT') e ON e.o_custkey = o.o_custkey AND e.d <= o.d
    GROUP BY 1, 2
""")
def as_of_join(spark, sf):
    """For each order the customer's last urgent day at or before it."""
    o = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "d", F.col("d").alias("last_day")).distinct()
    return tables.as_of(o.select("o_orderkey", "o_custkey", "d"), urgent, "o_custkey", "d", "last_day").select("o_orderkey", "o_custkey", "last_day")


# --- search and ranking ---------------------------------------------------------------------------------------------


@query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
    len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS dl FROM documents),
    tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, tot GROUP BY term, n),
    q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, doc_id AS doc, round(sum(qtf * idf * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
          FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY ALL)
    SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""")
def lexical_search(spark, sf):
    """BM25 of every benchmark item over all documents, ten best each."""
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return search.search_texts(read(spark, sf, "documents"), "doc_id", "text", items, 10, digits=6)


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS qid, v.vec_id AS doc, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.vec_id % 50 = 0)
    SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""")
def dense_search(spark, sf):
    """Exact vector search: queries are the ids divisible by 50, against all rows."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return search.dense_search(v, v.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vector"), 10, digits=6)


def two_rankings(spark, sf) -> DataFrame:
    """Customers of each nation by balance and by key, as two lists."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("ref"), "c_acctbal")
    lists = [search.top_ranked(c, ["qid"], order).withColumn("source", F.lit(i)) for i, order in enumerate(([F.desc("c_acctbal"), F.asc("ref")], [F.desc("ref")]))]
    return lists[0].unionByName(lists[1]).select("qid", "source", "ref", "rank")


_TWO = """
    c AS (SELECT c_nationkey AS qid, c_custkey AS ref, c_acctbal FROM customer),
    r AS (SELECT qid, 0 AS source, ref, row_number() OVER (PARTITION BY qid ORDER BY c_acctbal DESC, ref) AS rank FROM c
          UNION ALL SELECT qid, 1, ref, row_number() OVER (PARTITION BY qid ORDER BY ref DESC) FROM c)
"""


@query(f"""
    WITH {_TWO}, s AS (SELECT qid, ref, round(sum(1.0 / (60 + rank)), 12) AS score, min({{'s': source, 'r': rank}}) AS seen FROM r GROUP BY ALL)
    SELECT qid, ref, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, ref) AS INTEGER) AS rank FROM s
""")
def rank_fusion(spark, sf):
    """Reciprocal-rank fusion of two rankings per nation."""
    return ranking.reciprocal_rank_fusion(two_rankings(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"""
    WITH {_TWO}, o AS (SELECT qid, ref, rank, source, row_number() OVER (PARTITION BY qid, ref ORDER BY rank, source) AS n FROM r)
    SELECT qid, ref, CAST(place AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, source) AS place FROM o WHERE n = 1) WHERE place <= 7
""")
def balanced_round_robin(spark, sf):
    """Two lists taking turns, seven places each."""
    return ranking.round_robin(two_rankings(spark, sf).withColumnRenamed("source", "route"), 7)


def order_manifest(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    scope = F.when(F.col("o_orderstatus") == "F", "consolidated").when(F.col("o_orderstatus") == "O", "separate").otherwise("unknown")
    return o.select(F.col("o_orderkey").alias("table_ref"), (F.col("o_custkey") % 10).cast("string").alias("ticker"), F.year("o_orderdate").alias("report_year"), scope.alias("scope"), "o_totalprice", "o_custkey")


_MANIFEST = """
    m AS (SELECT o_orderkey AS ref, CAST(o_custkey % 10 AS VARCHAR) AS ticker, year(o_orderdate) AS y, o_custkey AS qid, o_totalprice,
                 CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'separate' ELSE 'unknown' END AS own FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o_totalprice DESC, ref) AS rank, CASE WHEN qid % 3 = 0 THEN 'separate' END AS scope FROM m)
"""


def ranked_orders(spark, sf) -> DataFrame:
    m = order_manifest(spark, sf).select(F.col("o_custkey").alias("qid"), F.col("table_ref").alias("ref"), "o_totalprice")
    out = search.top_ranked(m, ["qid"], [F.desc("o_totalprice"), F.asc("ref")])
    return out.withColumn("scope", F.when(F.col("qid") % 3 == 0, "separate"))


@query(f"""
    WITH {_MANIFEST}, t AS (SELECT *, coalesce(scope, 'consolidated') AS target FROM k),
    f AS (SELECT *, max(CASE WHEN own = target THEN 1 ELSE 0 END) OVER (PARTITION BY qid, ticker, y) AS there FROM t)
    SELECT qid, ref, CAST(rank AS INTEGER) AS rank FROM f WHERE NOT (own <> 'unknown' AND own <> target AND there = 1)
""")
def scope_routing(spark, sf):
    """Rankings without tables of the other statement where the wanted one is there."""
    return ranking.scope_filter(ranked_orders(spark, sf), order_manifest(spark, sf), "consolidated").select("qid", "ref", "rank")


@query(f"""
    WITH {_MANIFEST}, need AS (SELECT qid, y, min(rank) AS rank FROM k GROUP BY ALL),
    mark AS (SELECT k.qid, k.ref, k.rank, CASE WHEN need.rank IS NULL THEN 0 ELSE 1 END AS needed FROM k LEFT JOIN need ON need.qid = k.qid AND need.rank = k.rank),
    pick AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY needed DESC, rank) AS n, sum(needed) OVER (PARTITION BY qid) AS all_needed FROM mark)
    SELECT qid, ref, CAST(place AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM pick WHERE n <= greatest(5, all_needed)) WHERE place <= 5
""")
def route_coverage(spark, sf):
    """Five orders of each customer, the best of every year among them."""
    hits = ranked_orders(spark, sf).withColumn("score", F.col("o_totalprice")).select("qid", "ref", "score", "rank")
    m = order_manifest(spark, sf)
    years = m.groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_set("report_year").alias("years"), F.array().cast("array<string>").alias("tickers"))
    routes = ranking.routes(years).select("qid", "route", "ticker", "year", F.array().cast("array<string>").alias("scopes"))
    return ranking.keep_coverage(hits, routes, m, 5).select("qid", "ref", "rank")


@query(f"""
    WITH {_MANIFEST}, u AS (SELECT * FROM k WHERE own <> 'unknown')
    SELECT qid, ref, 'df' || CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS VARCHAR) AS variable FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 4
""")
def candidate_selection(spark, sf):
    """The first four usable tables of each ranking, named."""
    ranked = ranked_orders(spark, sf).withColumn("limit", ranking.candidate_limit(F.array(F.lit("a")), F.array(F.lit(1)), 4))
    usable = order_manifest(spark, sf).where("scope <> 'unknown'").select(F.col("table_ref").alias("ref"))
    return ranking.select_candidates(ranked, usable).select("qid", "ref", "variable")


@query(f"""
    WITH {_MANIFEST}, b AS (SELECT *, CASE WHEN own = 'consolidated' AND rank = 1 THEN 1 ELSE 0 END AS gold, 10 + length(CAST(ref AS VARCHAR)) AS cost FROM k),
    s AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY gold DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM b)
    SELECT qid, ref FROM s WHERE spent <= 60 OR gold = 1
""")
def prompt_budget(spark, sf):
    """Candidates that fit a cost budget, gold ones first."""
    m = order_manifest(spark, sf).select(F.col("table_ref").alias("ref"), F.col("scope").alias("own"))
    c = ranked_orders(spark, sf).join(m, "ref")
    c = c.withColumns({"gold": ((F.col("own") == "consolidated") & (F.col("rank") == 1)).cast("int"), "cost": 10 + F.length(F.col("ref").cast("string"))})
    return ranking.fit_budget(c, 60).select("qid", "ref")


@query("""
    SELECT n_name AS name, n_nationkey, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS index, CAST((row_number() OVER (ORDER BY n_name) - 1) % 3 AS INTEGER) AS shard FROM nation
""")
def global_positions(spark, sf):
    """Positions in a total order, and the shard each falls into."""
    out = ranking.global_index(read(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "name")
    return out.select("name", "n_nationkey", F.col("index").cast("long").alias("index"), F.pmod("index", F.lit(3)).cast("int").alias("shard"))


# --- questions ------------------------------------------------------------------------------------------------------


@query("""
    SELECT s_suppkey AS qid, list_sort([n_name[1:3], n_name[1:3]])[1] AS ticker, 2020 AS first_year, 2022 AS last_year, 'MILLION_VND' AS target_unit
    FROM supplier JOIN (SELECT n_nationkey, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS n_name FROM nation) ON n_nationkey = s_nationkey
""")
def query_specifications(spark, sf):
    """Company, periods and target of a question about each supplier's nation."""
    ticker = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    companies = read(spark, sf, "nation").select(ticker.alias("ticker"), F.concat(F.lit("Tổng công ty "), "n_name").alias("name"))
    asked = read(spark, sf, "supplier").withColumn("t", F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")))
    asked = asked.select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("Doanh thu của "), "t", F.lit(" từ 2020 đến 2022 là bao nhiêu triệu đồng?")).alias("question"))
    specs = questions.query_specs(asked, companies)
    years = F.col("periods.year")
    return specs.select("qid", F.get("entities", F.lit(0))["ticker"].alias("ticker"), F.array_min(years).alias("first_year"), F.array_max(years).alias("last_year"), "target_unit")


# --- programs -------------------------------------------------------------------------------------------------------

PANEL_YEARS = tuple(range(1995, 2002))
_PANEL = """
    p AS (SELECT n_nationkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
          WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL),
    full_p AS (SELECT * FROM p WHERE n_nationkey IN (SELECT n_nationkey FROM p GROUP BY 1 HAVING count(*) = 7))
"""


def panel(spark, sf) -> DataFrame:
    """Revenue and orders of every nation by year, as columns; nations with all years."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.withColumn("y", F.year("o_orderdate"))
    g = o.groupBy(F.col("c_nationkey").alias("n_nationkey")).pivot("y", list(PANEL_YEARS)).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("c"))
    for y in PANEL_YEARS:
        g = g.where(F.col(f"{y}_v").isNotNull())
    return g


def panel_cells(node):
    """Column 1 is revenue, column 2 the number of orders; the variable stands for the year."""
    return F.col(f"{PANEL_YEARS[int(node['variable'][2:]) - 1]}_{'v' if node['column'] == 1 else 'c'}")


def panel_programs() -> dict[str, nodes.Node]:
    values = [nodes.cell(f"df{i + 1}", 0, 1, dimension="VND") for i in range(len(PANEL_YEARS))]
    counts = [nodes.cell(f"df{i + 1}", 0, 2, dimension="COUNT") for i in range(len(PANEL_YEARS))]
    years = [nodes.literal(y, "YEAR") for y in PANEL_YEARS]
    change = nodes.binary("*", nodes.binary("/", nodes.binary("-", values[-1], values[0]), values[0]), nodes.literal(100))
    return {
        "growth": change,
        "mean": nodes.aggregate("mean", values),
        "best_year": nodes.arg_extremum("argmax", values, years),
        "busy_years": nodes.count_if(counts, ">", nodes.aggregate("mean", counts)),
        "median": nodes.select("median", values),
        "best_of_quiet": nodes.select("argmax", years, [(counts, "<=", nodes.aggregate("mean", counts))], values),
        "sum_of_busy": nodes.select("sum", values, [(counts, ">", nodes.aggregate("mean", counts))]),
    }


_PANEL_SQL = f"""
    WITH {_PANEL}, a AS (SELECT *, avg(c) OVER (PARTITION BY n_nationkey) AS ac FROM full_p)
    SELECT n_nationkey, round(((max(v) FILTER (y = 2001)) - max(v) FILTER (y = 1995)) / max(v) FILTER (y = 1995) * 100, 4) AS growth, round(avg(v), 2) AS mean,
           CAST(arg_max(y, {{'v': v, 'y': -y}}) AS DOUBLE) AS best_year, CAST(count(*) FILTER (c > ac) AS DOUBLE) AS busy_years, round(median(v), 2) AS median,
           CAST(arg_max(y, {{'v': v, 'y': -y}}) FILTER (c <= ac) AS DOUBLE) AS best_of_quiet, round(coalesce(sum(v) FILTER (c > ac), 0), 2) AS sum_of_busy
    FROM a GROUP BY n_nationkey
"""


@query(_PANEL_SQL)
def program_columns(spark, sf):
    """Seven programs as Columns over a panel."""
    return panel(spark, sf).select("n_nationkey", *[F.round(to_column(p, panel_cells), 4 if n == "growth" else 2).alias(n) for n, p in panel_programs().items()])


@query(_PANEL_SQL)
def program_text(spark, sf):
    """The same programs through their interchange text."""
    def at(variable, row, column, value):
        return panel_cells(nodes.cell(variable, row, column)).cast("double")

    names = {f"df{i + 1}" for i in range(len(PANEL_YEARS))}
    return panel(spark, sf).select("n_nationkey", *[F.round(text_to_column(to_text(p), names, at), 4 if n == "growth" else 2).alias(n) for n, p in panel_programs().items()])


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '<') AS n, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
    SELECT l_orderkey AS id, round(sum(CASE WHEN n = 1 OR n = total THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 6) AS answer,
           CASE WHEN max(total) = 1 THEN NULL ELSE 'VND' END AS dimension, CASE WHEN max(total) = 1 THEN 'DIMENSION' END AS error
    FROM r GROUP BY l_orderkey HAVING max(total) > 1
    UNION ALL
    SELECT l_orderkey, NULL, NULL, 'DIMENSION' FROM r GROUP BY l_orderkey HAVING max(total) = 1
""")
def program_batch(spark, sf):
    """A different program for every order, bound to its parsed cells and run in one plan.

    The first and last row are added; orders of one row ask for the wrong unit
    and are refused.  The cells are read three times, so they are written once.
    """
    c = stored(report_cells_of(spark, sf, ["table_ref", *FACT[1:]]), "cells")
    sizes = c.groupBy("table_ref").agg(F.max("row_index").alias("last"))
    cell = lambda row: F.concat(F.lit('{"kind":"cell","variable":"df1","row_index":'), row.cast("string"), F.lit(',"column_index":1}'))
    program = F.concat(F.lit('{"kind":"binary","operator":"+","left":'), cell(F.lit(0)), F.lit(',"right":'), cell(F.col("last")), F.lit("}"))
    unit = F.when(F.col("last") == 0, "PERCENT").otherwise("MILLION_VND")
    asked = sizes.select(text_id(F.col("table_ref")).alias("id"), program.alias("program"), unit.alias("target_unit"), F.when(F.col("last") == 0, 1.0).otherwise(1e6).alias("target_divisor"), F.array(F.lit("T")).alias("tickers"), F.array(F.lit(2024)).alias("years"))
    candidates = sizes.select(text_id(F.col("table_ref")).alias("id"), F.lit("df1").alias("variable"), "table_ref")
    return run_batch(asked, candidates, c).withColumn("answer", F.round("answer", 6))


def text_id(ref):
    return F.substring_index(ref, "|", 1).cast("long")


# --- answers --------------------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN abs(a) ELSE a END AS answer, o_custkey % 2 = 0 AND a < 0 AS changed,
           CASE WHEN o_custkey % 2 = 0 AND a < 0 THEN 'abs(df1)' ELSE 'df1' END AS pandas_query
    FROM (SELECT *, round(o_totalprice - 150000, 2) AS a FROM orders)
""")
def undirected_differences(spark, sf):
    """Negative answers lose their sign where the question asks for a plain difference."""
    asked = F.when(F.col("o_custkey") % 2 == 0, "Chênh lệch doanh thu là bao nhiêu?").otherwise("Doanh thu giảm bao nhiêu?")
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("question"), F.round(F.col("o_totalprice") - 150000, 2).alias("answer"), F.lit("df1").alias("pandas_query"))
    return answers.unsigned_differences(rows).select("id", "answer", "changed", "pandas_query")


def report_specs(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("qid"), F.array(F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("tickers"), F.array(F.lit(2020), F.lit(2021)).alias("years"), F.when(F.col("c_custkey") % 2 == 0, "separate").alias("scope"))


def report_names(spark, sf) -> DataFrame:
    """Nation reports: 2020 of both kinds, 2021 consolidated where the region's number is even."""
    n = read(spark, sf, "nation").withColumn("t", F.concat(F.lit("T"), F.col("n_nationkey").cast("string"), F.lit("_financial_statements_")))
    one = lambda s: n.select(F.concat("t", F.lit(s)).alias("doc_id"), "n_regionkey")
    return one("2020_separate").union(one("2020_consolidated")).union(one("2021_consolidated").where("n_regionkey % 2 = 0")).select("doc_id")


@query("""
    WITH d AS (SELECT n_nationkey AS n, n_regionkey % 2 = 0 AS both_years, 'T' || n_nationkey || '_financial_statements_' AS t FROM nation)
    SELECT c_custkey AS id,
           CASE WHEN c_custkey % 2 = 0 THEN [t || '2020_separate'] WHEN both_years THEN [t || '2020_consolidated', t || '2021_consolidated'] ELSE [t || '2020_consolidated'] END AS relevant_docs,
           CASE WHEN c_custkey % 2 = 0 THEN [t || '2020_separate|table_1', t || '2020_separate|table_2'] ELSE [t || '2020_consolidated|table_3'] END AS relevant_tables
    FROM customer JOIN d ON n = c_nationkey
""")
def routed_citations(spark, sf):
    """Citations widened inside the reports that a question's metadata names."""
    specs = report_specs(spark, sf)
    routes = answers.routed_documents(specs, report_names(spark, sf), "consolidated")
    t = F.concat(F.get("tickers", F.lit(0)), F.lit("_financial_statements_2020_"))
    ref = lambda s: F.concat(t, F.lit(s))
    predictions = specs.select(F.col("qid").alias("id"), F.array(ref("separate|table_1")).alias("relevant_tables"), F.array(F.lit("x")).alias("relevant_docs"))
    ranked = specs.select("qid", F.array(ref("consolidated|table_3"), ref("separate|table_1"), ref("separate|table_2")).alias("refs"))
    return answers.widen_citations(predictions, ranked, 5, routes, routes, router_only=True).select("id", "relevant_docs", "relevant_tables")


@query("""
    WITH m AS (SELECT l_orderkey, l_linenumber, 'D' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS d, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS g FROM lineitem),
    one AS (SELECT d, l_linenumber, min(g) AS g FROM m GROUP BY ALL), again AS (SELECT d, l_linenumber, row_number() OVER (ORDER BY d, l_linenumber) AS g FROM one)
    SELECT d || '|table_' || l_linenumber AS table_ref, d || '|' || (l_linenumber - 1) AS ordinal0, d || '|' || (10 * l_linenumber + 1) AS line1, d || '|' || g AS global FROM again
""")
def reference_grammars(spark, sf):
    """References rewritten by ordinal, line and corpus position."""
    m = read(spark, sf, "lineitem").select(F.concat(F.lit("D"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("doc_id"), F.col("l_linenumber").cast("int").alias("table_id")).distinct()
    m = m.withColumns({"table_ref": text.table_ref(F.col("doc_id"), F.col("table_id")), "line_no": F.col("table_id") * 10, "char_offset": F.lit(0), "page_no": F.lit(None).cast("int")})
    out = m.select("table_ref")
    for grammar in ("ordinal0", "line1", "global"):
        out = answers.retarget(out, grammar, m).withColumnRenamed("target", grammar)
    return out


def order_cells(spark, sf) -> DataFrame:
    """Order lines as cells of two tables per customer."""
    x = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select(
        F.col("o_custkey").alias("qid"), F.lit("df1").alias("variable"), F.col("l_orderkey").cast("int").alias("row_index"), F.col("l_linenumber").cast("int").alias("column_index"),
        F.when(F.col("l_returnflag") == "R", "doanh thu thuần").when(F.col("l_returnflag") == "A", "chi phí bán hàng").otherwise("thuế").alias("row_label"),
        F.concat(F.lit("Năm "), F.year("l_shipdate").cast("string")).alias("column_label"), F.col("l_extendedprice").alias("numeric_value"), F.col("l_extendedprice").alias("base_value"), F.lit("VND").alias("source_unit"),
    )


@query("""
    WITH x AS (SELECT o_custkey AS qid, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
                      2 * CASE l_returnflag WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN year(l_shipdate) = 1995 THEN 3 ELSE 0 END AS score
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT qid, CAST(l_orderkey AS INTEGER) AS row_index, CAST(l_linenumber AS INTEGER) AS column_index, CAST(score AS INTEGER) AS score
    FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, l_orderkey, l_linenumber) = 1
""")
def fallback_cells(spark, sf):
    """The best matching cell for each customer's question.  The cells are read three times, so they are written once."""
    c = stored(order_cells(spark, sf), "cells")
    asked = c.select("qid").distinct().select("qid", F.lit("Doanh thu thuần đã báo cáo").alias("question"), F.array(F.lit(1995)).alias("years"))
    return answers.best_cells(c, asked).select("qid", "row_index", "column_index", "score")


@query("""
    SELECT id, unnest(list_filter([CASE WHEN id % 7 = 1 THEN 'ANSWER' END, CASE WHEN id % 7 = 2 THEN 'QUERY' END, CASE WHEN id % 7 = 3 THEN 'TABLES' END, CASE WHEN id % 7 = 4 THEN 'CSV_PATH' END,
           CASE WHEN id % 7 = 5 THEN 'DOC_COVERAGE' END], lambda x: x IS NOT NULL)) AS code
    FROM (SELECT o_orderkey AS id FROM orders)
""")
def prediction_violations(spark, sf):
    """Broken rules of predictions with injected defects."""
    k = F.col("id") % 7
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice"))
    ref, doc = F.lit("d1|table_1"), F.when(k == 5, "d2").otherwise("d1")
    tables_ = F.when(k == 3, F.array(ref, ref)).otherwise(F.array(ref))
    evidence = F.array(F.struct(F.lit("df1").alias("variable"), F.when(k == 4, "data/../x.csv").otherwise("data/x.csv").alias("csv_path")))
    return answers.violations(rows.select("id", F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("answer"), F.when(k == 2, " ").otherwise("df1").alias("pandas_query"), F.array(doc).alias("relevant_docs"), tables_.alias("relevant_tables"), evidence.alias("evidence")))


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN 'MISSING' WHEN 2 THEN 'QUESTION' WHEN 3 THEN 'ANSWER' END AS code FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)
""")
def submission_reconciliation(spark, sf):
    """Rows missing, asked differently or not reproduced."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("q").alias("question"), F.col("o_totalprice").alias("answer"))
    k = F.col("id") % 5
    predictions = o.where(k != 1).withColumn("question", F.when(k == 2, "other").otherwise("q"))
    return answers.reconcile(predictions, o.select("id", "question"), o.select("id", (F.col("answer") + F.when(k == 3, 0.5).otherwise(0.001)).alias("answer")))


# --- quality --------------------------------------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT d.source, list(d.doc_id ORDER BY d.doc_id) FILTER (n_chars > 1500) AS got, list(d.doc_id) FILTER (quality = 1) AS gold FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id GROUP BY d.source),
    m AS (SELECT source, coalesce(len(list_intersect(got, gold)), 0) AS hits, coalesce(len(list_distinct(got)), 0) AS n, coalesce(len(list_distinct(gold)), 0) AS g FROM s),
    pr AS (SELECT source, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS p, CASE WHEN g > 0 THEN hits / g ELSE 0 END AS r FROM m)
    SELECT source, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS f2 FROM pr
""")
def retrieval_metrics(spark, sf):
    """Precision, recall and F2 of long documents against good ones, by source."""
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = read(spark, sf, "documents").join(labels, "doc_id", "left").groupBy("source").agg(F.collect_list(F.when(F.col("n_chars") > 1500, F.col("doc_id"))).alias("got"), F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("gold"))
    m = quality.f_beta(F.col("got"), F.col("gold"))
    return d.select("source", F.round(m["precision"], 6).alias("precision"), F.round(m["recall"], 6).alias("recall"), F.round(m["f"], 6).alias("f2"))


@query("""
    SELECT o_orderpriority, CAST(count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) <= 0.01) AS BIGINT) AS within, count(*) AS n FROM orders GROUP BY 1
""")
def answer_tolerance(spark, sf):
    """How many rounded prices are within a hundredth."""
    own = quality.within_tolerance(F.col("o_totalprice").cast("string"), F.round("o_totalprice", 1).cast("string"))
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(own).alias("within"), F.count("*").alias("n"))


@query("""
    WITH n AS (SELECT o_orderstatus AS status, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
    SELECT status, CAST(min(n) AS DOUBLE) AS min, round(avg(n), 3) AS mean, round(median(n), 3) AS median, round(quantile_cont(n, 0.95), 3) AS p95, CAST(max(n) AS DOUBLE) AS max FROM n GROUP BY status
""")
def count_profile(spark, sf):
    """Distribution of orders per customer, by status."""
    n = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), "o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy("status").agg(*quality.profile(n, "n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey DESC LIMIT 20")
def top_twenty(spark, sf):
    """The twenty customers with most orders (a top-k report)."""
    return quality.top_counts(read(spark, sf, "orders"), "o_custkey")


@query("""
    WITH c AS (SELECT p_brand AS stratum, count(*) AS n FROM part GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
    e AS (SELECT stratum, n, 100 * n / t AS exact FROM c, t), f AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, n DESC, stratum DESC) AS place FROM e)
    SELECT stratum, n, CAST(fl + CASE WHEN place <= 100 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS INTEGER) AS seats FROM f
""")
def seat_allocation(spark, sf):
    """A hundred seats shared among brands by largest remainder."""
    return quality.largest_remainder(read(spark, sf, "part").groupBy(F.col("p_brand").alias("stratum")).agg(F.count("*").alias("n")), 100)


@query("""
    WITH c AS (SELECT p_brand AS stratum, count(*) AS n FROM part GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
    e AS (SELECT stratum, n, 100 * n / t AS exact FROM c, t), f AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, n DESC, stratum DESC) AS place FROM e),
    s AS (SELECT stratum, fl + CASE WHEN place <= 100 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS seats FROM f)
    SELECT p_brand AS stratum, p_partkey FROM part JOIN s ON stratum = p_brand QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '/7'), p_partkey) <= any_value(seats) OVER (PARTITION BY p_brand)
""")
def stratified_subset(spark, sf):
    """The parts that fill those seats, by seeded hash."""
    p = read(spark, sf, "part").withColumnRenamed("p_brand", "stratum")
    return quality.stratified_sample(p, seat_allocation(spark, sf), "p_partkey", "stratum", 7).select("stratum", "p_partkey")


def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf, "orders")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("answer"), F.lit("q").alias("pandas_query"), F.array("o_orderstatus").alias("evidence"), F.array("o_orderpriority").alias("relevant_tables"), F.array(F.lit("d")).alias("relevant_docs"))
    k = F.col("id") % 10
    return base, base.withColumn("answer", F.col("answer") + F.when(k == 0, 1.0).otherwise(0.0)).withColumn("pandas_query", F.when(k < 2, "r").otherwise("q"))


@query("""
    SELECT count(*) AS questions, count(*) FILTER (o_orderkey % 10 = 0) AS answers, count(*) FILTER (o_orderkey % 10 < 2) AS pandas_queries, 0::BIGINT AS evidence, 0::BIGINT AS relevant_tables,
           0::BIGINT AS relevant_docs, count(*) FILTER (o_orderkey % 10 < 2) AS any
    FROM orders
""")
def run_comparison(spark, sf):
    """What changed between two runs over the same ids."""
    return quality.compare_runs(*runs(spark, sf)).drop("answer_ids", "any_ids")


@query("SELECT o_orderkey AS id, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS answer FROM orders")
def run_overlay(spark, sf):
    """A subset's answers laid over the baseline."""
    base, other = runs(spark, sf)
    part = other.where("id % 10 = 0")
    return quality.overlay(base, part, part.select("id")).select("id", "answer")


@query("SELECT o_orderkey AS id, o_totalprice AS answer FROM orders")
def shard_merge(spark, sf):
    """Three disjoint shards merged in order, repeats refused."""
    base, _ = runs(spark, sf)
    return quality.merge_shards([base.where(F.col("id") % 3 == i).select("id", "answer") for i in range(3)])


@query("""
    WITH r AS (SELECT o_custkey AS id, list(DISTINCT year(o_orderdate)) AS have, list(DISTINCT o_orderstatus) AS st FROM orders GROUP BY 1)
    SELECT id, list_filter([CASE WHEN id % 4 = 0 THEN 'unsupported_target_unit' END, CASE WHEN NOT (list_contains(have, 1995) OR list_contains(have, 1996)) THEN 'candidates_miss_required_year' END,
           CASE WHEN id % 4 <> 0 AND NOT list_contains(st, 'P') AND NOT list_contains(st, 'F') THEN 'no_candidate_carries_the_target_dimension' END], lambda x: x IS NOT NULL) AS blockers
    FROM r
""")
def feasibility_audit(spark, sf):
    """What blocks a question about 1995 in VND, by the units and years at hand."""
    unit = F.when(F.col("o_orderstatus") == "F", "MILLION_VND").when(F.col("o_orderstatus") == "O", "SHARES").otherwise("UNKNOWN")
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.year("o_orderdate")).alias("have_years"), F.collect_list(unit).alias("units"))
    rows = g.select("id", "have_years", "units", F.when(F.col("id") % 4 == 0, "UNKNOWN").otherwise("VND").alias("target_unit"), F.array(F.lit("T")).alias("tickers"), F.array(F.lit("T")).alias("have_tickers"), F.array(F.lit(1995)).alias("years"))
    return quality.feasibility(rows, 4096).select("id", "blockers")


@query("""
    SELECT 'duplicate_refs' AS code, count(*) FILTER (o_custkey % 10 = 4) AS n FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'unknown_refs', count(*) FILTER (o_custkey % 10 = 7) FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'row_or_question', count(*) FILTER (o_custkey % 10 = 1) FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def retrieval_quality(spark, sf):
    """Failure classes of rankings with injected defects."""
    m = order_manifest(spark, sf).select(F.col("table_ref").cast("string").alias("table_ref"), F.col("o_custkey").cast("string").alias("ticker"), "report_year", "scope", "o_custkey")
    k = F.col("id") % 10
    refs = m.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("table_ref")).alias("refs"))
    fused = F.when(k == 4, F.concat("refs", F.slice("refs", 1, 1))).when(k == 7, F.concat("refs", F.array(F.lit("none")))).otherwise(F.col("refs"))
    none = lambda kind: F.array().cast(kind)
    rows = refs.select("id", F.when(k == 1, "other").otherwise("q").alias("question"), F.array(F.col("id").cast("string")).alias("tickers"), none("array<int>").alias("years"), F.lit(None).cast("string").alias("scope"), fused.alias("fused"))
    found = quality.retrieval_violations(rows, refs.select("id", F.lit("q").alias("question")), m.drop("o_custkey"))
    return quality.taxonomy(found).select("code", "n")


@query("""
    WITH f AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'YEAR' WHEN 'O' THEN 'PERCENT' ELSE 'VND' END AS t, CASE WHEN o_custkey % 2 = 0 THEN 'select' ELSE 'binary' END AS k, o_orderpriority AS family FROM orders),
    p AS (SELECT unnest(['off', 'year', 'year-strict', 'year+percent', 'strict']) AS policy)
    SELECT policy, family, count(*) FILTER (NOT bad) AS allowed, count(*) FILTER (bad) AS forbidden
    FROM (SELECT *, (t = 'YEAR' AND ((policy IN ('year', 'year+percent') AND k = 'binary') OR policy IN ('year-strict', 'strict'))) OR (t = 'PERCENT' AND policy IN ('year+percent', 'strict') AND k = 'select') AS bad FROM f, p)
    GROUP BY ALL
""")
def root_policies(spark, sf):
    """Failed programs that each policy would have forbidden."""
    s = F.col("o_orderstatus")
    rows = read(spark, sf, "orders").select(F.when(s == "F", "YEAR").when(s == "O", "PERCENT").otherwise("VND").alias("target"), F.when(F.col("o_custkey") % 2 == 0, "select").otherwise("binary").alias("kind"), F.col("o_orderpriority").alias("family"))
    return quality.policy_projection(rows)


@query("""
    WITH h AS (SELECT o_orderkey, any_value(o_orderpriority) AS family, list(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey) AS hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT family, count(*) AS questions, CAST(sum(hits[1]) AS BIGINT) AS first, count(*) FILTER (list_sum(hits) > 0) AS solved, count(*) FILTER (list_sum(hits) = 1) AS once FROM h GROUP BY 1
""")
def attempt_hits(spark, sf):
    """Questions solved first, ever and exactly once, by family.

    Attempts of one line and part are in the order of the file, as a stable sort leaves them.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", place.alias("place"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("h"))
    x = lines.join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "place", "h")))
    g = x.groupBy("o_orderkey").agg(F.first("o_orderpriority").alias("family"), F.transform(rows, lambda r: r["h"]).alias("hits"))
    return quality.hit_counts(g)


@query("""
    SELECT median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS constrained, median(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS free,
           round(median(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS ratio
    FROM orders
""")
def decoding_medians(spark, sf):
    """Median rates of two modes and their ratio."""
    s = F.col("o_orderstatus")
    rows = read(spark, sf, "orders").select(F.when(s == "F", "json_schema").when(s == "O", "unconstrained").alias("mode"), F.col("o_totalprice").alias("rate"))
    return quality.decoding_report(rows).select("constrained", "free", F.round("ratio", 6).alias("ratio"))


@query("""
    SELECT o_custkey, CAST(greatest(1536, 512 + 150 * count(*)) AS INTEGER) AS answer_tokens, CAST(8192 - 40 * count(*) - 64 AS INTEGER) AS room,
           CAST(((count(*) % 7) - 3) % 5 + CASE WHEN ((count(*) % 7) - 3) % 5 < 0 THEN 5 ELSE 0 END AS INTEGER) AS wrapped
    FROM orders GROUP BY 1
""")
def token_budgets(spark, sf):
    """Answer tokens, room behind a prompt and a remainder with the divisor's sign."""
    n = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    return n.select("o_custkey", control.answer_tokens(F.col("n")).alias("answer_tokens"), control.output_room(8192, 40 * F.col("n")).alias("room"), numbers.python_mod(F.col("n") % 7 - 3, F.lit(5)).cast("int").alias("wrapped"))


# --- synthesis ------------------------------------------------------------------------------------------------------


def yearly_revenue(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    g = o.groupBy(F.col("c_nationkey").cast("string").alias("ticker"), F.year("o_orderdate").alias("report_year")).agg(F.round(F.sum("o_totalprice") * 1e6, 0).alias("base_value"), F.count("*").alias("orders"))
    return g.withColumns({"scope": F.lit("separate"), "label": F.lit("doanh thu"), "source_unit": F.lit("VND")})


_YEARLY = "y AS (SELECT CAST(c_nationkey AS VARCHAR) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS report_year, round(sum(o_totalprice) * 1e6, 0) AS v, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"""
    WITH {_YEARLY}, l AS (SELECT ticker, report_year, v, lag(v) OVER w AS e, lag(report_year) OVER w AS from_year FROM y WINDOW w AS (PARTITION BY ticker ORDER BY report_year))
    SELECT ticker, from_year, report_year, round((v - e) / e * 100, 4) AS answer FROM l WHERE abs(e) >= 1e9 AND abs((v - e) / e * 100) <= 500
""")
def yearly_changes(spark, sf):
    """Percentage changes of a line item from year to year."""
    return synthesis.changes(yearly_revenue(spark, sf)).select("ticker", "from_year", "report_year", F.round("answer", 4).alias("answer"))


@query("""
    WITH y AS (SELECT l_suppkey AS key, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS g, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL),
    s AS (SELECT key, list({'y': y, 'g': g, 'v': v} ORDER BY y) AS rows, list_sort(list(g)) AS gs FROM y GROUP BY 1 HAVING count(*) >= 3),
    t AS (SELECT key, rows, gs[greatest(0, CAST(floor(len(gs) / 2) AS INTEGER) - 1) + 1] AS threshold FROM s),
    k AS (SELECT *, list_filter(rows, lambda r: r.g > threshold) AS kept FROM t),
    b AS (SELECT *, list_sort(list_transform(kept, lambda r: {'k': -r.v, 'y': r.y})) AS bk, list_sort(list_transform(rows, lambda r: {'k': -r.v, 'y': r.y})) AS bp FROM k)
    SELECT key, threshold, CAST(len(kept) AS INTEGER) AS top_n, CAST(len(rows) AS INTEGER) AS of_years, -bk[1].k AS answer FROM b WHERE len(kept) >= 2 AND bk[1].y <> bp[1].y
""")
def conditional_extrema(spark, sf):
    """Each supplier's best year among the busier ones, where that is not the best of all."""
    y = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("year"))
    return synthesis.conditionals(y.agg(F.count("*").alias("gate"), F.round(F.sum("l_extendedprice"), 2).alias("value")))


@query(f"""
    WITH {_YEARLY} SELECT ticker, 'separate' AS scope, 'doanh thu' AS label FROM y GROUP BY ticker HAVING count(DISTINCT report_year) = (SELECT count(DISTINCT report_year) FROM y)
""")
def labels_in_all_years(spark, sf):
    """Relational division: line items present in every year on record."""
    y = yearly_revenue(spark, sf)
    n = y.select("report_year").distinct().count()
    return synthesis.shared_in_all(y, n)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round(100 * l_extendedprice / top, 6) AS answer
    FROM (SELECT *, max(l_extendedprice) OVER w AS top, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS top_part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    WHERE l_partkey <> top_part AND top * 1e5 >= 1e9
""")
def shares_of_largest(spark, sf):
    """Every line item as a percentage of the largest of its table."""
    li = read(spark, sf, "lineitem")
    label = F.concat(F.lit("khoản mục số "), F.col("l_partkey").cast("string"))
    c = li.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.lit("t")).alias("table_ref"), F.col("l_linenumber").alias("row_index"), F.lit(1).alias("column_index"), label.alias("row_label"),
        F.lit("Năm 2024").alias("column_label"), F.lit(2024).alias("report_year"), (F.col("l_extendedprice") * 1e5).alias("base_value"), F.col("l_extendedprice").alias("numeric_value"), F.lit("VND").alias("source_unit"),
    )
    out = synthesis.ratios(c)
    return out.select(F.substring_index("table_ref", "/", 1).cast("long").alias("l_orderkey"), F.col("row_index").alias("l_linenumber"), F.regexp_extract("row_label", r"(\d+)$", 1).cast("long").alias("l_partkey"), F.round("answer", 6).alias("answer"))


# --- streaming ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def streamed_ingestion(spark, sf):
    """Events drained from a file stream into a keyed table, twice, and summed."""
    path = new_path(spark, "ingest")
    table = KeyedTable(spark, path, "event_id", "v1")
    schema = read(spark, sf, "events").schema
    stream = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    run_available(stream(), table, f"{path}/checkpoint-1")
    run_available(stream(), table, f"{path}/checkpoint-2")
    return table.read().groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
