"""Steps that larger tables need: the same results by other means, and plans that read their input once."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellquarry.functions import numbers, plain, text, units
from cellquarry.operators import quality, search, synthesis, tables
from cellquarry.plans import interchange
from cellquarry.sources import shared

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "-", "—", "(5)", "()", "(", "(1.234,5)", "1.234", "1,234", "1.234.567,8", "1,234,567.8", "1,2,3", "12.345%", "5 đồng", "7 VND", "(9) vnd", "1e5", "+3", "-4,5", "--4", "1 234", "9" * 400, "đồng", "Đồng",
    "Tỷ lệ", "triệu đồng", "Triệu USD", "Số cổ phần", "Giá trị cổ phần", "%", "US Dollar", "Đơn vị tính: nghìn đồng", "đvt : tỷ đồng", "unitary", "Currency USD", "Don vi", "x y", "\x1c7", "7 ", "VỐN", "é", "Part 17",
]
FRAGMENTS = [
    "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td colspan=2>", '<td rowspan="3" class="x">', "<th>", "</th>", "a", "1.234,5", "Đơn vị tính: triệu đồng", "\n1. Chi tiết\n", "\n===== PAGE 3 =====\n", "&amp;", "<b>x</b>",
    "<br/>", " ", "</table >", "</table\n>", "<TABLE>", "<TD>", "x<y", ">", "\nDVT: USD\n", "İ", "<!-- c -->", "<td", "—", "\n\n", "<td>x</td><td>y</td></tr>", "<tr><td>Part 1</td><td>5</td></tr>", "(7)", "%",
]


def odd_reports(spark, n=300):
    r = random.Random(4)
    texts = [f"Đơn vị: USD\n<table>{''.join(r.choices(FRAGMENTS, k=r.randint(1, 40)))}</table>{''.join(r.choices(FRAGMENTS, k=6))}<table><tr><td>z</td></tr></table>" for _ in range(n)]
    return spark.createDataFrame([("T", 2024, f"d{i}", "separate", "p", t) for i, t in enumerate([*texts, None, ""])], "ticker string, year int, doc_id string, scope string, path string, text string")


def test_plain_rules_are_those_of_columns(spark):
    n, u = numbers.parse_number(F.col("x")), units.detect_unit(F.col("x"))
    for r in spark.createDataFrame([(x,) for x in ODD], "x string").select("x", n.alias("n"), u.alias("u"), units.is_declaration(F.col("x")).alias("d")).collect():
        assert plain.parse_number(r["x"]) == (r["n"]["value"], r["n"]["is_missing"], r["n"]["is_dash"]), r["x"]
        assert (plain.detect_unit(r["x"]), plain.is_declaration(r["x"])) == (r["u"], r["d"]), r["x"]


def test_one_pass_gives_the_tables_and_cells_that_columns_give(spark):
    keep = ["ticker", "year", "doc_id", "scope", "path"]
    kinds = [c.split()[0] for c in tables.STRUCTURE.split(", ")]
    once = tables.parse_reports(odd_reports(spark), keep, ["table_id", "matrix", "context", "declaration", "local_section", "numbered_section", *kinds, "n_rows", "n_cols", "row_labels"]).cache()
    again = tables.with_structure(once.drop(*kinds, "n_rows", "n_cols", "row_labels"))
    again = again.withColumns({"n_rows": F.size("rows"), "n_cols": F.size("headers"), "row_labels": tables.distinct_labels(F.flatten("rows"), tables.MOST_LABELS)})
    listed = lambda df: {(r["doc_id"], r["table_id"]): [r[c] for c in (*kinds, "n_rows", "n_cols", "row_labels")] for r in df.collect()}
    assert len(listed(once)) > 600 and listed(once) == listed(again)
    named = again.withColumnRenamed("year", "report_year").withColumn("table_ref", F.concat("doc_id", F.lit("|table_"), "table_id"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(tables.parse_cells(odd_reports(spark))) == rows(tables.to_cells(named))


def test_numbers_of_a_table_are_counted_as_its_coordinates(spark):
    cells = tables.numeric_coordinates(tables.parse_cells(odd_reports(spark))).select("table_ref", F.size("at").alias("n"))
    once = tables.parse_reports(odd_reports(spark), ["doc_id"], ["table_id", "n_numbers"]).where("n_numbers > 0").select(F.concat("doc_id", F.lit("|table_"), "table_id"), "n_numbers")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, cells.collect()))


@pytest.mark.parametrize("name, passes", [("corpus_summary", 1), ("drifted_references", 0), ("table_contexts", 1), ("report_manifest", 1), ("report_cells", 1)])
def test_reports_are_made_and_parsed_once(spark, name, passes):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == passes and plan.count("collect_list") == (name not in ("corpus_summary", "drifted_references"))


@pytest.mark.parametrize("name", ["program_batch", "lenient_batch"])
def test_batches_parse_their_reports_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and plan.count("MapInArrow") == 2  # the cells are read back; programs are read and run


def test_routes_are_served_by_equal_keys(spark):
    known = [("A", 1, "unknown"), ("A", 2, "separate"), ("B", 1, "consolidated"), (None, 1, "separate"), ("C", None, None), ("A", 2, "separate")]
    asked = [(i, t, y, s) for i, (t, y, s) in enumerate((t, y, s) for t in ("A", "B", "C", "D", None) for y in (1, 2, None) for s in ("separate", "consolidated", "unknown", None))]
    fits = lambda a, k: a[1] in (None, k[0]) and a[2] in (None, k[1]) and (a[3] is None or k[2] == "unknown" or a[3] == k[2])
    want = {a for a in asked if any(fits(a, k) for k in known)}
    a = spark.createDataFrame(asked, "id int, ticker string, year int, scope string")
    k = spark.createDataFrame([(i, *x) for i in range(len(asked)) for x in known], "id int, own_ticker string, own_year int, own_scope string")
    for by in ([], ["id"]):
        got = quality._served(a, k if by else k.drop("id"), "left_semi", by)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        assert {tuple(r) for r in quality._served(a, k if by else k.drop("id"), "left_anti", by).collect()} == set(asked) - want
    plan = __spark_entry__.queries()["retrieval_quality"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_ids_of_codes(spark):
    rows = spark.createDataFrame([("a", i % 150) for i in range(400)] + [("b", 3), ("b", None)], "code string, id int")
    assert {r["code"]: (r["n"], r["examples"]) for r in quality.taxonomy(rows).collect()} == {"a": (400, list(range(100))), "b": (2, [3])}


def test_tied_attempts_are_in_the_order_of_the_file(spark, tmp_path):
    lines = [(1, 1, 5, "R"), (1, 1, 5, "A"), (2, 1, 5, "A"), (2, 1, 5, "R"), (3, 2, 5, "R"), (3, 1, 9, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "x") for i in (1, 2, 3)], "o_orderkey long, o_orderpriority string").write.parquet(f"file://{tmp_path}/orders.parquet")
    assert [tuple(r) for r in __spark_entry__.queries()["attempt_hits"](spark, f"file://{tmp_path}").collect()] == [("x", 3, 1, 3, 3)]


TEXTS = [
    "df1['x'].sum()", "df1.loc[(df1['x'] > df2['x'].min()) & (df1['y'] == 'a'), 'x'].mean()", "max(df1['x']) if len(df1['x']) > 1 else -1", "(_v0 := df1.loc[df1['y'] == 'a', 'x'], _v0.max() - _v0.min())[-1]", "round(df1['x'].round(1).median(), 0)",
    "df1['x'].fillna(2).sum() / df2['x'].item()", "df1['x'].iloc[-1] ** 2 % 7", "sum([True, 1 < 2 and 2 < 1 or False, abs(-3)])", "float(df1['x'].iloc[5])", "min(1, float('nan'))", "sum(df1['x'])", "(_v1 := 1 > 2, 5 if _v1 else 6)[-1]",
    "df1.loc[(df1['x'] >= df2.loc[df2['x'] > 0, 'x'].sum()) & (df1['x'] <= 9), 'x'].sum()",
]


def test_prepared_text_gives_what_direct_reading_gives():
    direct = lambda text, frames: interchange._answer(interchange._Translator(interchange.Numbers, frames.get, None).value(interchange._parsed(text)))
    rows = lambda xs: [{"x": x, "y": "ab"[i % 2]} for i, x in enumerate(xs)]
    for a in ([3.0, 1.0, 8.25], [None, 2.0], [], [1.0, float("nan"), 4.04]):
        for b in ([1.0], [], [0.5, -2.0]):
            for text in TEXTS:
                frames = {"df1": rows(a), "df2": rows(b)}
                want = direct(text, frames)
                assert interchange.evaluate_text(text, frames) == (None if want is None or want != want else want), text
    with pytest.raises(interchange.ProgramError):
        interchange.evaluate_text(TEXTS[1], {"df1": []})


def test_text_is_read_once_for_many_frames(monkeypatch):
    read = []
    monkeypatch.setattr(interchange, "_parsed", lambda text, f=interchange._parsed: read.append(text) or f(text))
    assert [interchange.evaluate_text("df1['x'].sum() + 0.125", {"df1": [{"x": float(i)}]}) for i in range(50)] == [i + 0.125 for i in range(50)]
    assert len(read) == 1


def test_dense_search_by_blocks_is_that_of_columns(spark, monkeypatch):
    monkeypatch.setattr(search, "DOC_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    r = random.Random(2)
    vectors = [[round(r.gauss(0, 1), 1) for _ in range(4)] for _ in range(150)] + [[1.0, 0.0, 0.0, 0.0]] * 30
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 1.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
    v = spark.createDataFrame(list(enumerate(vectors + odd)), "doc long, vector array<float>").repartition(5)
    q = v.where("doc % 9 = 0 or doc >= 178").select(F.col("doc").alias("qid"), "vector")
    n = lambda c: search.normalized(F.col(c))
    for k, digits in ((3, 6), (12, 2)):
        pairs = v.crossJoin(q.withColumnRenamed("vector", "other")).select("qid", "doc", F.round(search.dot(n("vector"), n("other")), digits).alias("score"))
        want = search.top_ranked(pairs, ["qid"], [F.desc("score"), F.asc("doc")], k)
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(search.dense_search(v, q, k, digits)) == rows(want)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id int")
    out = quality.merge_outputs(ids(*range(1000), 1, None), ids(5, 2000, None), ids(*range(3, 1003), None))
    assert out.rdd.getNumPartitions() == 21
    want = [(5, "BOTH"), (None, "BOTH"), (0, "NO_TRACE"), (1, "NO_TRACE"), (2, "NO_TRACE"), *((i, "NO_PREDICTION") for i in (1000, 1001, 1002))]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    plan = __spark_entry__.queries()["fallback_cells"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "l_orderkey" not in plan  # the join is not made twice


def test_askable_labels(spark):
    labels = ["Doanh thu thuần", "- Doanh thu thuần", "(Doanh thu thuần)", "• Doanh thu thuần", "Tổng cộng phát sinh", "Số dư đầu kỳ năm", "12 tháng của năm", "!!!!!!!!!!!!!!", "ngắn", "  Chi phí bán hàng ", "Cộng các khoản mục", "Tại ngày 31/12/2024", "Chi phí tại xưởng", "", None, "+ Lãi tiền gửi khác"]
    frame = spark.createDataFrame([(x,) for x in labels], "x string")
    own, folded = F.trim("x"), text.fold_label_native(F.col("x"))
    marked = F.exists(F.array(*map(F.lit, synthesis.SUBITEM_MARKS)), lambda m: own.startswith(m)) | F.exists(F.array(*map(F.lit, synthesis.ROLLFORWARD)), lambda m: F.contains(folded, m))
    want = (F.length(own) >= synthesis.LEAST_LABEL) & ~marked & (folded != "") & ~folded.rlike("^[0-9]")
    both = frame.select(F.coalesce(want, F.lit(False)), F.coalesce(synthesis.askable(F.col("x")), F.lit(False))).collect()
    assert [r[0] for r in both] == [r[1] for r in both] and sum(r[0] for r in both) == 3
    plan = __spark_entry__.queries()["shares_of_largest"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") == 0 and plan.count("lower(") == 2  # a label is folded to test it and to compare it


def test_texts_are_searched_as_by_an_index(spark, monkeypatch):
    monkeypatch.setattr(search, "DOC_WEIGHTS", 200)
    r = random.Random(3)
    words = [f"từ{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(120)] + ["từ1 từ2"] * 15 + [None, "", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    asked = spark.createDataFrame([("a", "từ1 từ2 từ2"), ("b", "Từ5 khác từ7 từ9"), ("c", "nothing"), ("d", None)], "qid string, text string")
    rows = lambda df: sorted((x["qid"], x["rank"], x["doc"], round(x["score"], 6)) for x in df.collect())
    want = rows(search.search(search.build_index(docs, "id", "text"), asked, 7, digits=6))
    assert len(want) == 14 and rows(search.search_texts(docs, "id", "text", asked, 7, digits=6)) == want
    twice = docs.union(docs.limit(5))
    assert rows(search.search_texts(twice, "id", "text", asked, 7, digits=6)) == rows(search.search(search.build_index(twice, "id", "text"), asked, 7, digits=6))
    with pytest.raises(ValueError):
        search.search_texts(docs.limit(0), "id", "text", asked, 7)
