"""More registered queries: sources and sinks, text, questions, answers, audits and samples.

As in `queries`, inputs are derived from the driver's tables inside each query.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import arrays, text
from .operators import answers, control, quality, questions, ranking, search, synthesis, tables
from .plans import nodes
from .plans.bind import FACT, run_batch
from .plans.interchange import evaluate_text, text_to_column, to_text
from .queries import order_cells, order_manifest, order_reports, order_tables, query, ranked_orders, read, report_cells_of, report_names, report_specs, text_id, yearly_revenue
from .sources import io
from .sources.shared import new_path, stored

# --- order and shards -----------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT {_LINE}, CAST(row_number() OVER (ORDER BY {_LINE}) - 1 AS BIGINT) AS index FROM lineitem")
def line_positions(spark, sf):
    """The position of every order line in a total order, with its payload."""
    names = _LINE.split(", ")
    return ranking.global_index(read(spark, sf, "lineitem").select(*names), *names).select(*names, F.col("index").cast("long").alias("index"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 1000 AND i % 3 = 1")
def limited_shards(spark, sf):
    """The second of three shards of a request's first thousand orders."""
    return ranking.limited_shard(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 3, 1)


@query("SELECT CAST(i - 1 AS INTEGER) AS pos, c_custkey, c_acctbal FROM (SELECT unnest([7, 3, 11, 5]) AS c_custkey, unnest([1, 2, 3, 4]) AS i) JOIN customer USING (c_custkey)")
def requested_order(spark, sf):
    """Customers in the order in which they are asked for."""
    wanted = spark.createDataFrame([([7, 3, 11, 5],)], "ids array<long>")
    return ranking.reorder(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", wanted).select(F.col("pos").cast("int").alias("pos"), "c_custkey", "c_acctbal")


# --- text, arrays, JSON ---------------------------------------------------------------------------------------------


@query(r"""
    SELECT o_orderkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Doanh thu "thuần" & khác' WHEN '2-HIGH' THEN 'Cộng hòa' ELSE 'a b' END AS tidied,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'doanh thu thuần khác' WHEN '2-HIGH' THEN 'cộng hòa' ELSE 'a b' END AS folded,
           CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN 'Thuyết minh ' || o_orderkey ELSE '' END AS section,
           o_orderpriority = '2-HIGH' AS proper, o_orderpriority = '1-URGENT' AS titled, o_orderpriority <> '2-HIGH' AS quoted,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'Doanh thu thuần của năm nay là bao nhiêu?' ELSE 'Sao? Nói thêm' END AS asked, 'x' || o_orderkey AS stripped, 'Á' || chr(10) || 'a' AS doubled
    FROM orders
""")
def text_idioms(spark, sf):
    """Tidying, folding and tests of labels, sections and questions."""
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    pick = lambda a, b, c: F.when(p == "1-URGENT", a).when(p == "2-HIGH", b).otherwise(c)
    raw = pick(F.lit("Doanh thu “thuần” &amp;  khác"), F.lit("Cộng  hòa"), F.lit("  a\n b "))
    section = pick(F.lit("Tầng 5, ABC Tower"), F.concat(F.lit(" Thuyết minh "), key), F.lit("12.345 - 6"))
    label = pick(F.lit("Doanh thu thuần"), F.lit("Công ty Hòa Phát Việt"), F.lit("chi phí bán hàng"))
    question = F.concat(F.lit("Hỏi "), F.lower(label), F.lit(" năm nay?"))
    asked = F.when(p == "1-URGENT", "Doanh thu thuần của năm nay là bao nhiêu? Xin cảm ơn").otherwise("Sao? Nói thêm")
    titled = pick(F.lit("của Hòa Phát ạ"), F.lit("của hòa phát"), F.lit("Hòa nhã"))
    return read(spark, sf, "orders").select(
        "o_orderkey", text.normalize_text(raw).alias("tidied"), text.fold_label(text.normalize_text(raw)).alias("folded"), text.usable_section(section).alias("section"), text.is_proper_noun(label).alias("proper"),
        text.has_titled(titled, F.lit("hoa phat")).alias("titled"), text.quotes_label(question, label).alias("quoted"), text.trim_to_question(asked).alias("asked"),
        text.strip_ascii_copy(F.concat(F.lit("x"), key, F.lit("\nkhong dau: y"))).alias("stripped"), text.search_text(F.lit("Á")).alias("doubled"),
    )


@query("""
    SELECT c_custkey AS id, ['b', CAST(c_nationkey AS VARCHAR)] AS tail, [1 * c_nationkey, 2 * 10] AS products, 'z' AS first_z, [] :: VARCHAR[] AS none, 'left' AS found, 'no' AS missing,
           '{"a":1,"b":null}' AS json, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE [2020, 2021] END AS years, c_custkey % 3 = 2 AS broken
    FROM customer
""")
def array_and_json_idioms(spark, sf):
    """Slices, strict zips, defaults, overlays and typed JSON."""
    c = read(spark, sf, "customer")
    nation, k = F.col("c_nationkey"), F.col("c_custkey") % 3
    maps = arrays.overlay(F.create_map(F.lit("x"), F.lit("right"), F.lit("w"), F.lit("w")), F.create_map(F.lit("x"), F.lit("left")))
    years = F.when(k == 0, "[2020,2021]").when(k == 1, '["2020","2021"]').otherwise('["2020","x"]')
    spec = arrays.typed_spec(F.concat(F.lit('{"id":"'), F.col("c_custkey").cast("string"), F.lit('","tickers":["A"],"years":'), years, F.lit("}")))
    out = c.select(
        arrays.tail(F.array(F.lit("a"), F.lit("b"), nation.cast("string")), 2).alias("tail"), arrays.strict_zip(F.array(nation, F.lit(2).cast("long")), F.array(F.lit(1), F.lit(10)), lambda a, b: a * b).alias("products"),
        arrays.first_match(F.array(F.lit("q"), F.lit("z")), lambda x: x > "q").alias("first_z"), arrays.or_empty(F.lit(None).cast("array<string>")).alias("none"), arrays.map_or(maps, F.lit("x"), F.lit("no")).alias("found"),
        arrays.map_or(maps, F.lit("y"), F.lit("no")).alias("missing"), F.to_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")), {"ignoreNullFields": "false"}).alias("json"), spec.alias("s"),
    )
    return out.select(F.col("s.id").alias("id"), "tail", "products", "first_z", "none", "found", "missing", "json", F.col("s.years").alias("years"), F.col("s.broken").alias("broken"))


@query("SELECT c_nationkey, map_from_entries(list((m, n) ORDER BY m)) :: VARCHAR AS counts FROM (SELECT c_nationkey, c_mktsegment AS m, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1")
def sorted_counters(spark, sf):
    """Customers by segment in key order, as text."""
    n = read(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("m")).agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(arrays.sorted_counts("m").alias("x"))
    pairs = F.transform(F.map_entries("x"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return n.select("c_nationkey", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("counts"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("""
    SELECT c_custkey AS id, 'N' || c_nationkey AS ticker, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 2015 + c_custkey % 4 END AS year, 'bctc_' || CASE c_custkey % 3 WHEN 0 THEN 'hop_nhat' WHEN 1 THEN 'cong_ty_me' ELSE 'khac' END AS doc_id,
           c_custkey % 4 <> 3 AS path_ok, CASE c_custkey % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' ELSE 'unknown' END AS scope,
           CASE WHEN c_custkey % 2 = 0 THEN '31/12/' || (2015 + c_custkey % 4) END AS year_end, 2 AS openings, 1 AS closings, 1 AS matched
    FROM customer
""")
def report_metadata(spark, sf):
    """What paths, names and first lines of reports give away, and their markup counts."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "hop_nhat").when(k % 3 == 1, "cong_ty_me").otherwise("khac")
    year = F.when(k % 4 == 3, F.lit("x")).otherwise((2015 + k % 4).cast("string"))
    body = F.concat(F.when(k % 2 == 0, F.concat(F.lit("cho năm tài chính kết thúc vào  ngày 31/12/"), (2015 + k % 4).cast("string"))).otherwise(""), F.lit(" <table><tr></tr></table> <TABLE>"))
    rows = read(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("/in/n"), F.col("c_nationkey").cast("string"), F.lit("/"), year, F.lit("/bctc_"), kind, F.lit("/a.txt")).alias("path"), body.alias("text"))
    out, counts = io.path_parts(rows), tables.markup_counts(F.col("text"))
    return out.select("id", "ticker", "year", "doc_id", "path_ok", "scope", io.fiscal_year_end(F.col("text")).alias("year_end"), counts["openings"].alias("openings"), counts["closings"].alias("closings"), counts["matched"].alias("matched"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '|table_1' AS table_ref, ['Đơn vị tính: triệu đồng', '1. Chi tiết'] AS context, '1. Chi tiết' AS local_section, count(*) * 2 AS numbers FROM lineitem GROUP BY l_orderkey")
def table_contexts(spark, sf):
    """The lines above each table, its own section and how many of its cells are numbers."""
    t = order_tables(spark, sf, ["context", "local_section", "n_numbers"]).where("n_numbers > 0")
    return t.select("table_ref", "context", "local_section", F.col("n_numbers").alias("numbers"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS report_year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL")
def partitioned_round_trip(spark, sf):
    """Orders written by year and read back for one year, whose folder alone is scanned."""
    path = new_path(spark, "partitioned")
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.year("o_orderdate").alias("report_year"), "o_totalprice")
    io.write_partitioned(o, path, ("report_year",))
    back = spark.read.parquet(path).where("report_year = 1996")
    return back.groupBy("ticker", "report_year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey AS id, 'Hỏi ' || o_orderkey AS question, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS answer, ['d'] AS relevant_docs FROM orders")
def jsonl_round_trip(spark, sf):
    """Predictions written as JSON lines, turned to parquet by schema and read back."""
    path = new_path(spark, "jsonl")
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("Hỏi "), k.cast("string")).alias("question"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("answer"), F.array(F.lit("d")).alias("relevant_docs"))
    io.write_jsonl(rows, f"{path}/lines")
    io.jsonl_to_parquet(spark, f"{path}/lines", f"{path}/table", io.PREDICTIONS)
    return spark.read.parquet(f"{path}/table").select("id", "question", "answer", "relevant_docs")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '|table_1' AS table_ref, sum(CAST(CAST(l_quantity AS BIGINT) AS DOUBLE)) AS total, count(*) AS n FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey")
def evidence_csv_round_trip(spark, sf):
    """Cells of some tables written as CSV and looked up again by reference."""
    path = new_path(spark, "csv")
    r = order_reports(spark, sf).where(F.col("doc_id").cast("long") % 5 == 0)
    cells = io.read_cells(r)
    io.write_cells_csv(cells.withColumn("year", F.col("report_year")), path, ["year"])
    back = io.read_cells_csv(spark, path)
    refs = back.select("table_ref").distinct()
    found = io.point_cells(back, refs.withColumn("unit", F.lit("VND")), refs)
    return found.where("column_index = 1").groupBy("table_ref").agg(F.sum("numeric_value").alias("total"), F.count("*").alias("n"))


@query("SELECT c_custkey AS id, 'df' || v AS variable, 'd' || c_custkey || '|table_' || v AS table_ref, 'data/' || v || '.csv' AS csv_path FROM customer, (SELECT unnest([1, 2]) AS v)")
def restored_evidence(spark, sf):
    """Evidence paired with cited tables by position."""
    key = F.col("c_custkey").cast("string")
    one = lambda v: F.concat(F.lit("d"), key, F.lit(f"|table_{v}"))
    evidence = F.array(*[F.struct(F.lit(f"df{v}").alias("variable"), F.lit(f"data/{v}.csv").alias("csv_path")) for v in (1, 2)])
    p = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), evidence.alias("evidence"), F.array(one(1), one(2)).alias("relevant_tables"))
    cells = p.select(F.explode("relevant_tables").alias("table_ref"))
    return io.restore_evidence(p, cells).select("id", "variable", "table_ref", "csv_path")


@query("SELECT o_orderkey AS table_ref FROM orders WHERE o_orderkey % 7 = 0")
def missing_references(spark, sf):
    """References that the manifest does not hold."""
    m = order_manifest(spark, sf)
    return io.missing_refs(m.where("table_ref % 7 <> 0"), m.select("table_ref"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '|table_1' AS table_ref FROM lineitem WHERE l_orderkey % 11 = 0 GROUP BY l_orderkey")
def drifted_references(spark, sf):
    """Tables whose markup has changed since the manifest was made.  The markup is read twice, so it is written once."""
    t = stored(order_tables(spark, sf, ["html"]).select("table_ref", "html"), "markup")
    manifest = t.select("table_ref", F.sha2("html", 256).alias("html_sha256"))
    changed = F.substring_index("table_ref", "|", 1).cast("long") % 11 == 0
    return io.drifted(manifest, t.withColumn("html", F.when(changed, F.concat("html", F.lit(" "))).otherwise(F.col("html"))))


# --- search and ranking ---------------------------------------------------------------------------------------------


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS qid, v.vec_id AS doc, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.vec_id % 50 = 0)
    SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 3
""")
def saved_dense_search(spark, sf):
    """Vector search over an index that was saved, counted and loaded; queries are the ids divisible by 50."""
    path = new_path(spark, "dense")
    v = read(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    search.DenseIndex(v, v.count()).save(path)
    index = search.DenseIndex.load(spark, path)
    return search.dense_search(index.vectors, v.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vector"), 3, digits=6)


@query("SELECT item_id AS doc, [CAST(length(text) AS FLOAT), CAST(1 AS FLOAT)] AS vector FROM benchmark WHERE item_id % 2 = 1")
def resumed_encoding(spark, sf):
    """Vectors of the items that were not encoded yet, long texts first."""
    b = read(spark, sf, "benchmark")
    return search.encode(b, b.where("item_id % 2 = 0").select("item_id"), lambda texts: [[float(len(t)), 1.0] for t in texts], "item_id", "text", 16)


@query("""
    WITH m AS (SELECT o_orderkey AS doc, CAST(o_custkey % 10 AS VARCHAR) AS ticker, year(o_orderdate) AS y, CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'separate' ELSE 'unknown' END AS scope FROM orders)
    SELECT n_nationkey AS qid, doc FROM nation JOIN m ON (n_regionkey = 0 OR ticker = CAST(n_nationkey % 10 AS VARCHAR)) AND y IN (1995, 1996) AND (n_regionkey <> 1 OR scope IN ('separate', 'unknown'))
""")
def metadata_filter(spark, sf):
    """Tables that each nation's metadata allows; an empty set asks for nothing."""
    n, none = read(spark, sf, "nation"), F.array().cast("array<string>")
    q = n.select(
        F.col("n_nationkey").alias("qid"), F.when(F.col("n_regionkey") == 0, none).otherwise(F.array((F.col("n_nationkey") % 10).cast("string"))).alias("tickers"), F.array(F.lit(1995), F.lit(1996)).alias("years"),
        F.when(F.col("n_regionkey") == 1, ranking.widened_scope(F.lit("separate"))).otherwise(none).alias("scopes"),
    )
    return search.allowed_by(order_manifest(spark, sf), q)


@query("""
    SELECT c_custkey AS qid, greatest(5, c_nationkey) AS output, greatest(1, CAST(ceil(greatest(5, c_nationkey) / c_nationkey) AS INTEGER)) AS per_route,
           'q' || chr(10) || 'ma co phieu: T' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'nam bao cao: 2020' ELSE '' END AS asked,
           'q T 2020 separate' || chr(10) || 'q t 2020 separate' AS searched
    FROM customer WHERE c_nationkey > 0
""")
def route_queries(spark, sf):
    """Budgets of routes and the texts that are searched for."""
    c = read(spark, sf, "customer").where("c_nationkey > 0")
    output, per_route = ranking.route_budget(F.col("c_nationkey"), 5)
    year = F.when(F.col("c_custkey") % 2 == 0, F.lit(2020))
    searched = search.query_text(F.lit("q"), F.array(F.lit("T")), F.array(F.lit(2020)), F.array(F.lit("separate")))
    return c.select(F.col("c_custkey").alias("qid"), output.alias("output"), per_route.alias("per_route"), search.augmented(F.lit("q"), F.lit("T"), year).alias("asked"), searched.alias("searched"))


@query("SELECT c_nationkey AS qid, c_custkey AS ref, CAST(row_number() OVER w AS INTEGER) AS rank FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w <= 3")
def reranked(spark, sf):
    """Candidates by a supplied score."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("ref"), F.col("c_acctbal").alias("score"))
    return ranking.rerank(c, 3).select("qid", "ref", "rank")


@query("""
    WITH o AS (SELECT o_custkey AS doc, o_orderkey AS ref, o_orderpriority = '1-URGENT' AS gold FROM orders), g AS (SELECT doc AS qid, doc, ref FROM o WHERE gold)
    SELECT qid, ref FROM (SELECT q.qid, o.ref FROM (SELECT DISTINCT qid, doc FROM g) q JOIN o USING (doc) WHERE NOT gold)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5(ref || '/5'), ref) <= 2
""")
def distractor_tables(spark, sf):
    """Two other orders of each customer with an urgent one."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_ref"), "o_orderpriority")
    gold = o.where("o_orderpriority = '1-URGENT'").select(F.col("doc_id").alias("qid"), "doc_id", F.col("table_ref").alias("ref"))
    return ranking.distractors(gold, o.select("doc_id", "table_ref"), 2, 5).select("qid", "ref")


# --- questions ------------------------------------------------------------------------------------------------------


def holdings(spark, sf) -> DataFrame:
    """A company for each nation."""
    n = read(spark, sf, "nation")
    return n.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"), F.concat(F.lit("CTCP "), F.initcap("n_name"), F.lit(" Holdings Group")).alias("name"))


_HOLDINGS = "h AS (SELECT n_nationkey, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) || ' holdings group' AS x FROM nation)"


@query(f"""
    WITH {_HOLDINGS}, a AS (SELECT ticker, unnest([x, 'ctcp ' || x, 'cong ty co phan ' || x, array_to_string(string_split(x, ' ')[-2:], ' '), array_to_string(string_split(x, ' ')[-3:], ' '),
        CASE WHEN len(string_split(x, ' ')) >= 4 THEN array_to_string(string_split(x, ' ')[-4:], ' ') END]) AS alias FROM h)
    SELECT alias, min(ticker) AS ticker, false AS brand FROM (SELECT DISTINCT * FROM a WHERE alias IS NOT NULL) GROUP BY alias HAVING count(*) = 1
""")
def company_aliases(spark, sf):
    """Names that stand for one company alone."""
    return questions.alias_table(holdings(spark, sf)).select("alias", "ticker", "brand")


@query(f"""
    WITH {_HOLDINGS} SELECT s_suppkey AS qid, ticker, CASE WHEN s_suppkey % 2 = 0 THEN 0.98 ELSE 1.0 END :: DOUBLE AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'alias' ELSE 'ticker' END AS method, 15 AS position
    FROM supplier JOIN h ON n_nationkey = s_nationkey
""")
def company_mentions(spark, sf):
    """Companies that questions name by alias or ticker."""
    n, s = holdings(spark, sf), read(spark, sf, "supplier")
    s = s.join(n, F.col("ticker") == F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")))
    named = F.when(F.col("s_suppkey") % 2 == 0, F.regexp_replace("name", "^CTCP ", "")).otherwise(F.col("ticker"))
    asked = s.select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("Doanh thu của "), named, F.lit(" năm 2020?")).alias("question"))
    return questions.resolve(asked, n).select("qid", "ticker", "confidence", "method", "position")


@query(f"WITH {_HOLDINGS} SELECT n_nationkey AS qid, ticker, 1.0 :: DOUBLE AS confidence FROM h WHERE n_nationkey % 2 = 0")
def company_guesses(spark, sf):
    """The clear best match of texts that name no company exactly; none for other texts."""
    n = holdings(spark, sf).withColumn("name", F.regexp_replace("name", "^CTCP | Holdings Group$", ""))
    asked = n.select(F.substring("ticker", 2, 2).cast("long").alias("qid"), text.ascii_words(F.col("name")).alias("plain"))
    asked = asked.withColumn("plain", F.when(F.col("qid") % 2 == 0, F.concat(F.col("plain"), F.lit(" hoi gi"))).otherwise("khong co ten nao"))
    return questions.fuzzy(asked, n).select("qid", "ticker", "confidence")


@query(f"WITH {_HOLDINGS} SELECT n_nationkey AS qid, ticker FROM h")
def asked_companies(spark, sf):
    """Whose figures are asked, where another company is a counterparty."""
    n = holdings(spark, sf).withColumn("k", F.substring("ticker", 2, 2).cast("long"))
    total = F.max("k").over(synthesis.Window.partitionBy()) + 1  # a row per nation
    other = n.select(((F.col("k") + 1) % total).alias("k"), F.regexp_replace("name", "^CTCP ", "").alias("other"))
    own = F.regexp_replace("name", "^CTCP ", "")
    asked = n.join(other, "k").select(F.col("k").alias("qid"), F.concat(F.lit("Lợi nhuận của "), own, F.lit(", giao dịch bán hàng với "), F.col("other"), F.lit(" là bao nhiêu?")).alias("question"))
    return questions.targets(asked, n.select("ticker", "name")).select("qid", "ticker")


# --- programs -------------------------------------------------------------------------------------------------------


def priced_frames(spark, sf) -> DataFrame:
    """Order lines as the rows of one frame per order."""
    row = F.struct(F.col("l_linenumber").cast("int").alias("row_index"), F.lit(1).alias("column_index"), F.col("l_returnflag").alias("row_label"), F.col("l_quantity").cast("double").alias("base_value"))
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))


FRAME_TEXTS = {
    "total": "df1['base_value'].sum()",
    "mean_returned": "df1.loc[df1['row_label'] == 'R', 'base_value'].fillna(0).mean()",
    "middle": "float(df1['base_value'].astype(float).median())",
    "spread": "(_v0 := df1.loc[(df1['row_index'] > 0) & (df1['column_index'] == 1), 'base_value'], _v0.max() - _v0.min())[-1]",
    "lines": "len(df1['base_value']) + round(0.5)",
}
_FRAMES = """
    SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS total, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_returned, round(median(l_quantity), 6) AS middle,
           CAST(max(l_quantity) - min(l_quantity) AS DOUBLE) AS spread, CAST(count(*) AS DOUBLE) AS lines
    FROM lineitem GROUP BY 1
"""


@query(_FRAMES)
def frame_programs(spark, sf):
    """Pandas text over whole columns of a frame, as Columns."""
    found = {name: text_to_column(t, {"df1"}, frames=lambda _: F.col("rows")) for name, t in FRAME_TEXTS.items()}
    return priced_frames(spark, sf).select("l_orderkey", *[F.round(c, 6).alias(n) for n, c in found.items()])


@query(_FRAMES)
def frame_reexecution(spark, sf):
    """The same text run again over rows in Arrow batches, as validation does."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, listed = batch.column("l_orderkey"), batch.column("rows")
            rows = iter(listed.flatten().to_pylist())
            frames = [{"df1": list(islice(rows, n or 0))} for n in listed.value_lengths().to_pylist()]
            found = [pa.array([evaluate_text(t, f) for f in frames], pa.float64()) for t in FRAME_TEXTS.values()]
            yield pa.RecordBatch.from_arrays([keys, *found], ["l_orderkey", *FRAME_TEXTS])

    kinds = ", ".join(f"{n} double" for n in FRAME_TEXTS)
    again = priced_frames(spark, sf).mapInArrow(run, f"l_orderkey long, {kinds}")
    return again.select("l_orderkey", *[F.round(n, 6).alias(n) for n in FRAME_TEXTS])


COHORT = 32


@query(f"""
    WITH r AS (SELECT l_suppkey, round(l_extendedprice, 2) AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) <= {COHORT})
    SELECT l_suppkey, round(median(v), 4) AS middle, round(max(v), 2) AS greatest FROM r GROUP BY 1 HAVING count(*) = {COHORT}
""")
def cohort_texts(spark, sf):
    """The median and maximum of a wide cohort by text that binds every cell once, run in Arrow batches.

    As a Column such text is one very large expression; `evaluate_text` walks it.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    line = search.top_ranked(read(spark, sf, "lineitem"), ["l_suppkey"], [F.asc(c) for c in order], COHORT)
    cohorts = line.groupBy("l_suppkey").agg(F.collect_list(F.round("l_extendedprice", 2)).alias("members")).where(F.size("members") == COHORT)
    cells = [nodes.cell(f"df{i}", 0, 1) for i in range(1, COHORT + 1)]
    texts = [to_text(nodes.select(op, cells), bound=True) for op in ("median", "max")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            frames = [{f"df{i}": [{"row_index": 0, "column_index": 1, "base_value": v}] for i, v in enumerate(members, 1)} for members in batch.column("members").to_pylist()]
            found = [pa.array([evaluate_text(t, f) for f in frames], pa.float64()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("l_suppkey"), *found], ["l_suppkey", "middle", "greatest"])

    found = cohorts.mapInArrow(run, "l_suppkey long, middle double, greatest double")
    return found.select("l_suppkey", F.round("middle", 4).alias("middle"), F.round("greatest", 2).alias("greatest"))


@query("""
    SELECT l_orderkey AS id, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS answer, 'VND' AS dimension, CAST(NULL AS VARCHAR) AS error
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '<') = 1
""")
def lenient_batch(spark, sf):
    """Programs that point at a row's label are moved to its only number.  The cells are read often, so they are written once."""
    c = stored(report_cells_of(spark, sf, ["table_ref", *FACT[1:]]).where("column_index < 2"), "cells")
    one = c.select("table_ref").distinct().withColumn("id", text_id(F.col("table_ref")))
    program = '{"kind":"cell","variable":"df1","row_index":0,"column_index":0}'
    asked = one.select("id", F.lit(program).alias("program"), F.lit("MILLION_VND").alias("target_unit"), F.lit(1e6).alias("target_divisor"), F.array(F.lit("T")).alias("tickers"), F.array(F.lit(2024)).alias("years"))
    return run_batch(asked, one.select("id", F.lit("df1").alias("variable"), "table_ref"), c, lenient=True)


# --- answers --------------------------------------------------------------------------------------------------------


@query("""
    WITH x AS (SELECT o_custkey AS qid, l_orderkey, l_linenumber, l_extendedprice, 2 * CASE l_returnflag WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN year(l_shipdate) = 1995 THEN 3 ELSE 0 END AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey
               QUALIFY row_number() OVER (PARTITION BY o_custkey, l_orderkey, l_linenumber ORDER BY l_extendedprice) = 1)
    SELECT qid, round(l_extendedprice / 1000, 6) AS answer FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, l_orderkey, l_linenumber) = 1
""")
def fallback_values(spark, sf):
    """The best matching cell in thousands."""
    c = stored(search.top_ranked(order_cells(spark, sf), ["qid", "row_index", "column_index"], [F.asc("base_value")], 1).drop("rank"), "cells")  # a line number may stand twice
    asked = c.select("qid").distinct().select("qid", F.lit("Doanh thu thuần đã báo cáo").alias("question"), F.array(F.lit(1995)).alias("years"))
    return answers.fallback_answers(answers.best_cells(c, asked), asked.select("qid", F.lit(1000.0).alias("target_divisor"))).select("qid", F.round("answer", 6).alias("answer"))


@query("""
    WITH k AS (SELECT o_custkey AS qid, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus IN ('F', 'O'))
    SELECT qid AS id, list(ref ORDER BY rank) AS relevant_tables FROM k WHERE rank <= 4 GROUP BY qid
""")
def prompt_citations(spark, sf):
    """The tables that a prompt showed, in order."""
    ranked = ranked_orders(spark, sf).withColumn("limit", F.lit(4))
    usable = order_manifest(spark, sf).where("scope <> 'unknown'").select(F.col("table_ref").alias("ref"))
    return answers.cite_candidates(ranking.select_candidates(ranked, usable))


_REPORTS = "d AS (SELECT n_nationkey AS n, n_regionkey % 2 = 0 AS both_years, 'T' || n_nationkey || '_financial_statements_' AS t FROM nation)"


def report_tables(spark, sf) -> DataFrame:
    """Two tables in each nation report."""
    return report_names(spark, sf).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("table_id")).select("doc_id", "table_id", text.table_ref(F.col("doc_id"), F.col("table_id")).alias("table_ref"), (F.col("table_id") * 10).alias("line_no"), F.lit(0).alias("char_offset"), F.lit(None).cast("int").alias("page_no"))


@query(f"""
    WITH {_REPORTS} SELECT c_custkey AS id, list_transform(flatten(list_transform(CASE WHEN c_custkey % 2 = 0 THEN ['2020_separate'] WHEN both_years THEN ['2020_consolidated', '2021_consolidated'] ELSE ['2020_consolidated'] END,
        lambda s: [t || s || '|table_1', t || s || '|table_2'])), lambda r: r) AS relevant_tables
    FROM customer JOIN d ON n = c_nationkey
""")
def routed_tables(spark, sf):
    """Every table of every report that a question's metadata names."""
    specs = report_specs(spark, sf)
    routes = answers.routed_documents(specs, report_names(spark, sf), "consolidated")
    return answers.cite_routed(routes, report_tables(spark, sf), specs.select("qid", F.array(F.lit("x")).alias("refs")))


@query(f"""
    WITH {_REPORTS} SELECT c_custkey AS id, abs(round(c_acctbal, 2)) AS answer, CASE WHEN c_acctbal < 0 THEN 'abs(df1)' ELSE 'df1' END AS pandas_query,
           CASE WHEN c_custkey % 2 = 0 THEN [t || '2020_separate'] WHEN both_years THEN [t || '2020_consolidated', t || '2021_consolidated'] ELSE [t || '2020_consolidated'] END AS relevant_docs,
           CASE WHEN c_custkey % 2 = 0 THEN [t || '2020_separate|20', t || '2020_separate|10'] ELSE [t || '2020_consolidated|10'] END AS relevant_tables
    FROM customer JOIN d ON n = c_nationkey
""")
def finalized_predictions(spark, sf):
    """Predictions in the fixed profile."""
    specs = report_specs(spark, sf)
    t = F.concat(F.get("tickers", F.lit(0)), F.lit("_financial_statements_2020_"))
    ref = lambda s: F.concat(t, F.lit(s))
    value = read(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.round("c_acctbal", 2).alias("answer"))
    cited = F.when(F.col("qid") % 2 == 0, F.array(ref("separate|table_2"))).otherwise(F.array(ref("consolidated|table_1")))
    p = specs.join(value, "qid").select(F.col("qid").alias("id"), F.lit("Chênh lệch là bao nhiêu?").alias("question"), "answer", F.lit("df1").alias("pandas_query"), cited.alias("relevant_tables"), F.array(F.lit("x")).alias("relevant_docs"))
    ranked = specs.select("qid", F.array(ref("separate|table_2"), ref("separate|table_1")).alias("refs"))
    return answers.finalize(p, ranked, specs, report_tables(spark, sf)).select("id", "answer", "pandas_query", "relevant_docs", "relevant_tables")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 1")
def reused_executions(spark, sf):
    """Predictions that were validated as they are."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("q").alias("question"), F.col("o_totalprice").alias("answer"), F.lit(None).cast("string").alias("pandas_query"), F.array(F.lit("e")).alias("evidence"))
    return answers.reusable(o, o.withColumn("answer", F.when(F.col("id") % 4 == 1, F.col("answer") + 1).otherwise(F.col("answer"))))


@query("""
    SELECT 'D' || l_orderkey || '|table_' || l_linenumber AS table_ref, 'table_' || l_linenumber AS table_n, l_linenumber :: VARCHAR AS ordinal, 'table_' || (l_linenumber - 1) AS table_n0, (10 * l_linenumber) :: VARCHAR AS line,
           (10 * l_linenumber - 1) :: VARCHAR AS line0, (100 + l_linenumber) :: VARCHAR AS "char", CASE WHEN l_linenumber % 2 = 0 THEN '3' ELSE '-1' END AS page
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
""")
def more_reference_grammars(spark, sf):
    """References in the other seven grammars, without their documents."""
    m = read(spark, sf, "lineitem").select(F.concat(F.lit("D"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.col("l_linenumber").cast("int").alias("table_id")).distinct()
    n = F.col("table_id")
    m = m.withColumns({"table_ref": text.table_ref(F.col("doc_id"), n), "line_no": n * 10, "char_offset": n + 100, "page_no": F.when(n % 2 == 0, 3)})
    out = m.select("table_ref")
    for grammar in ("table_n", "ordinal", "table_n0", "line", "line0", "char", "page"):
        out = answers.retarget(out, grammar, m).withColumn(grammar, F.substring_index("target", "|", -1)).drop("target")
    return out


# --- quality --------------------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'scores are missing' WHEN 1 THEN 'fused and reranked differ' WHEN 2 THEN 'scores do not cover every hybrid ref' WHEN 3 THEN 'scores do not fall' WHEN 4 THEN 'a score is not finite' END AS error
    FROM orders
""")
def reranker_checks(spark, sf):
    """What is wrong with rerankings that have injected defects."""
    k = F.col("o_orderkey") % 6
    refs = F.array(F.lit("a"), F.lit("b"))
    score = lambda ref, value: F.struct(F.lit(ref).alias("table_ref"), value.cast("double").alias("score"))
    second = F.when(k == 3, 3.0).when(k == 4, float("nan")).otherwise(1.0)
    scores = F.when(k == 2, F.array(score("a", F.lit(2.0)))).when(k != 0, F.array(score("a", F.lit(2.0)), score("b", second)))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), refs.alias("hybrid"), refs.alias("reranked"), F.when(k == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(refs).alias("fused"), scores.alias("reranker_scores"))
    return rows.select("id", quality.reranker_error().alias("error"))


@query("""
    WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT (SELECT count(*) FROM r) AS documents, (SELECT count(*) FROM r) AS tables, 1 AS tickers, 0 :: BIGINT AS year_ends, 1.0 AS least, 1.0 AS middle
""")
def corpus_summary(spark, sf):
    """Documents, tables and companies of the derived reports, which are written once."""
    reports = stored(order_reports(spark, sf), "reports")
    out = quality.corpus_audit(io.read_tables(reports, []).select("doc_id"), reports.withColumn("fiscal_year_end", io.fiscal_year_end(F.col("text"))))
    return out.select("documents", "tables", F.col("tickers").cast("int").alias("tickers"), "year_ends", F.col("tables_per_document.min").alias("least"), F.col("tables_per_document.median").alias("middle"))


@query("SELECT count(*) AS questions, count(*) AS ids, max(c_custkey) = count(*) AND min(c_custkey) = 1 AS sequential, count(*) FILTER (c_custkey % 9 = 0) AS empty, count(*) FILTER (c_custkey % 9 <> 0 AND c_custkey % 2 = 0) AS several_years FROM customer")
def question_summary(spark, sf):
    """Ids, empty questions and questions of several years."""
    k = F.col("c_custkey")
    q = F.when(k % 9 == 0, " ").when(k % 2 == 0, "từ 2019 đến 2021").otherwise("năm 2020, 2020")
    return quality.question_audit(read(spark, sf, "customer").select(k.alias("id"), q.alias("question")))


@query("""
    SELECT o_orderkey AS id, 'BOTH' AS code FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'NO_TRACE' FROM orders WHERE o_orderkey % 10 = 2
    UNION ALL SELECT o_orderkey, 'NO_PREDICTION' FROM orders WHERE o_orderkey % 10 = 3
""")
def merged_outputs(spark, sf):
    """Rows of merged shards that do not fit each other."""
    o, k = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), F.col("id") % 10
    return quality.merge_outputs(o.where(k != 3), o.where(k == 1), o.where(k != 2))


@query("SELECT p_brand AS name FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 50) > 1")
def conflicting_files(spark, sf):
    """Names that shards hold with different contents."""
    return quality.file_conflicts(read(spark, sf, "part").select(F.col("p_brand").alias("name"), control.file_hash((F.col("p_size") % 50).cast("string").cast("binary")).alias("sha")))


@query("SELECT o_orderpriority AS blocker, count(*) AS n, list_sort(list(o_orderkey))[1:40] AS ids FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def blocker_report(spark, sf):
    """How many questions each blocker stops, with the first ids."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("blockers"))
    return quality.blocker_counts(o)


@query("SELECT count(*) AS traces, count(*) FILTER (o_orderkey % 5 = 0) AS fallbacks, round(median(o_totalprice), 4) AS median_latency, CAST(NULL AS DOUBLE) AS median_tokens FROM orders")
def run_medians(spark, sf):
    """Fallbacks and medians of a run; a median over nothing is null."""
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 5 == 0).alias("fallback"), F.col("o_totalprice").alias("latency"), F.lit(None).cast("double").alias("tokens"))
    return quality.run_summary(o).withColumn("median_latency", F.round("median_latency", 4))


@query("""
    SELECT o_orderpriority AS family, o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '/3'), o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 30 ELSE 1 END
""")
def family_quotas(spark, sf):
    """A seeded sample with a quota for each family."""
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"))
    return quality.quota_sample(o, {"1-URGENT": 0.3, "2-HIGH": 0.001}, 100, "id", "family", 3).select("family", "id")


# --- synthesis and control ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS table_ref FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '1-URGENT' AND o_custkey % 5 >= 3")
def usable_manifest(spark, sf):
    """Tables with a unit, a scope and enough rows."""
    o = order_manifest(spark, sf).join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("table_ref"), "o_orderpriority"), "table_ref")
    m = o.select("table_ref", "scope", F.when(F.col("o_orderpriority") == "1-URGENT", "UNKNOWN").otherwise("VND").alias("unit"), (F.col("o_custkey") % 5).alias("n_rows"), F.lit(2).alias("n_cols"))
    return synthesis.usable_tables(m).select("table_ref")


def priced_cells(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("table_ref"), F.col("l_linenumber").cast("int").alias("row_index"), F.lit(1).alias("column_index"), F.concat(F.lit("khoản mục số "), F.col("l_partkey").cast("string")).alias("row_label"), F.lit("Năm 2024").alias("column_label"),
        F.lit(2024).alias("report_year"), F.col("l_extendedprice").alias("base_value"), F.col("l_quantity").cast("double").alias("numeric_value"), F.when(F.col("l_returnflag") == "R", "UNKNOWN").when(F.col("l_returnflag") == "A", "PERCENT").otherwise("VND").alias("source_unit"),
    )


@query("SELECT l_orderkey AS table_ref, l_linenumber :: INTEGER AS row_index, CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS DOUBLE) ELSE l_extendedprice END AS answer FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice > 0")
def lookup_samples(spark, sf):
    """Single cells in a known unit."""
    return synthesis.lookups(priced_cells(spark, sf)).select("table_ref", F.col("cell.row_index").alias("row_index"), "answer")


@query("""
    WITH y AS (SELECT c_nationkey :: VARCHAR AS ticker, year(o_orderdate) :: INTEGER AS y, round(sum(o_totalprice) * 1e6, 0) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) >= 1994 AND year(o_orderdate) < 1999 GROUP BY ALL)
    SELECT ticker, count(*) AS years, arg_max(y, {'v': v, 'y': -y}) AS answer FROM y GROUP BY 1 HAVING count(*) BETWEEN 3 AND 5
""")
def yearly_extrema(spark, sf):
    """The best year of a line item over three to five years."""
    return synthesis.extrema(yearly_revenue(spark, sf).where("report_year >= 1994 and report_year < 1999")).select("ticker", "years", "answer")


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN o_totalprice <= 500 WHEN 2 THEN false ELSE true END AS accepted FROM orders
""")
def accepted_samples(spark, sf):
    """Samples with finite, plausible answers."""
    k = F.col("o_orderkey") % 4
    answer = F.when(k == 0, float("nan")).when(k == 2, 0.0).otherwise(F.col("o_totalprice"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), synthesis.acceptable(F.when(k == 1, "PERCENT").otherwise("VND"), answer, F.lit(3)).alias("accepted"))


@query("""
    SELECT l_orderkey AS id, CASE WHEN min(l_linenumber % 2) = 0 THEN 'Phải trả' ELSE '▪ Phải trả' END AS row_label, CAST(count(*) FILTER (l_quantity > 20) AS INTEGER) AS top_n, CAST(count(*) AS INTEGER) AS of_years
    FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 20) >= 2
""")
def gate_conditions(spark, sf):
    """Conditions recovered from the cells that a program compares."""
    li = read(spark, sf, "lineitem")
    label = F.when(F.col("l_linenumber") % 2 == 0, "Phải trả").otherwise("▪ Phải trả")
    return synthesis.recover_conditions(li.select(F.col("l_orderkey").alias("id"), label.alias("row_label"), F.col("l_quantity").cast("double").alias("base_value"), F.lit(20.0).alias("threshold")))


@query("SELECT c_nationkey :: VARCHAR AS ticker, year(o_orderdate) :: INTEGER AS report_year, list_sort(list(DISTINCT o_orderpriority)) AS refs FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def label_years(spark, sf):
    """The tables that hold a label, by year."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    series = o.select(F.col("c_nationkey").cast("string").alias("ticker"), F.lit("s").alias("scope"), F.lit("x").alias("label"), F.year("o_orderdate").alias("report_year"), F.col("o_orderpriority").alias("table_ref"))
    return synthesis.label_index(series).select("ticker", "report_year", "refs")


@query(r"""
    SELECT c_custkey AS id, 'Viết một câu hỏi về khoản mục "Tiền"' || CASE WHEN c_custkey % 2 = 0 THEN ' (mục: 1. Quỹ)' ELSE '' END || ' của ' || c_name || ' năm 2020, đơn vị VND.' AS rendering,
           'Question: Q' || chr(10) || 'Answer unit: VND' || chr(10) || 'Read every ticker of: A, B' || chr(10) || 'Read every year of: 2020' || chr(10) || 'Cohort size: 2' || chr(10) || 'S' || c_custkey AS prompt,
           CASE WHEN c_custkey % 2 = 0 THEN 'MISSING_YEARS' ELSE 'HARD' END AS refusal
    FROM customer
""")
def prompts(spark, sf):
    """Requests for questions and programs, and the class of refusals."""
    k = F.col("c_custkey")
    rendering = synthesis.rendering_prompt(F.col("c_name"), F.lit("Tiền"), F.lit(2020), F.lit("VND"), F.when(k % 2 == 0, "1. Quỹ"))
    prompt = control.program_prompt(F.lit("Q"), F.lit("VND"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit(2020)), F.array(F.concat(F.lit("S"), k.cast("string"))))
    return read(spark, sf, "customer").select(k.alias("id"), rendering.alias("rendering"), prompt.alias("prompt"), control.refusal_class(F.when(k % 2 == 0, "MISSING_YEARS").otherwise("OTHER")).alias("refusal"))
