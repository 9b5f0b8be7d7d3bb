from pyspark.sql import functions as F

from cellquarry.operators import tables
from cellquarry.sources.io import fiscal_year_end, path_parts, read_reports, read_tables, scope_of

REPORT = """===== PAGE 1 =====
Đơn vị tính: VND
1. Doanh thu hoạt động tài chính
<table><tr><td>Chỉ tiêu</td><td>Năm 2018</td></tr><tr><td>Lãi tiền gửi</td><td>208.253.201.298</td></tr></table>
===== PAGE 2 =====
5.1. Tiền và tương đương tiền
<table><tr><td>Chỉ tiêu<td>2024</tr><tr><td>A. Tài sản<td>-<tr><td>Tiền<td>(1.234)</table>
"""


def reports(spark, text=REPORT):
    return spark.createDataFrame([("AAA", 2018, "AAA_financial_statements_2018_separate", "separate", "p", text)], "ticker string, year int, doc_id string, scope string, path string, text string")


def test_rowspan_reaches_as_far_as_the_table():
    rows = "<tr><td rowspan=5000>a</td><td>0</td></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 1500))
    assert tables.to_matrix(f"<table>{rows}</table>") == [["a", str(i)] for i in range(1500)]


def test_matrix():
    spans = "<table><tr><th rowspan=2>Chỉ tiêu</th><th colspan=2>Kỳ</th></tr><tr><td>2024</td><td>2023</td></tr><tr><td>Doanh thu</td><td>10</td><td>9</td></tr></table>"
    assert tables.to_matrix(spans) == [["Chỉ tiêu", "Kỳ", "Kỳ"], ["Chỉ tiêu", "2024", "2023"], ["Doanh thu", "10", "9"]]
    assert tables.to_matrix("") == [] and tables.to_matrix(None) == []
    assert tables.to_matrix("<table><tr><td colspan=x>a</td></tr><tr></tr></table>") == [["a"]]


def test_end_to_end(spark):
    t = read_tables(reports(spark)).cache()
    rows = {r["table_id"]: r for r in t.collect()}
    assert [rows[i]["page_no"] for i in (1, 2)] == [1, 2] and rows[1]["line_no"] == 4
    assert rows[2]["section_title"] == "5.1. Tiền và tương đương tiền" and rows[2]["unit"] == "VND" and len(rows[2]["context"]) == 1
    assert rows[2]["headers"] == ["Chỉ tiêu", "2024"] and rows[2]["header_rows"] == 1
    cells = {(r["table_ref"][-1], r["row_index"], r["column_index"]): r for r in tables.to_cells(t).collect()}
    assert cells["1", 0, 1]["base_value"] / 1e6 == 208253.201298
    assert cells["2", 1, 1]["numeric_value"] == -1234.0 and cells["2", 0, 1]["is_dash"]
    m = {r["table_id"]: r for r in tables.to_manifest(t).collect()}
    assert m[1]["row_labels"] == ["Lãi tiền gửi"] and "208" not in m[1]["retrieval_text"] and len(m[1]["html_sha256"]) == 64
    counts = spark.range(1).select(tables.markup_counts(F.lit(REPORT)).alias("c")).first()["c"]
    assert tuple(counts) == (2, 2, 2)


def test_empty_texts(spark):
    assert read_tables(reports(spark, "")).count() == 0 and read_tables(reports(spark, None)).count() == 0


def test_outline(spark):
    rows = [["A. Tài sản", ""], ["I. Ngắn hạn", ""], ["1. Tiền", "5"], ["- Tiền mặt", "3"], ["Tổng cộng", "9"]]
    got = spark.createDataFrame([(rows,)], "rows array<array<string>>").select(tables.row_parents(F.col("rows")).alias("p")).first()["p"]
    assert got == [[], ["A. Tài sản"], ["A. Tài sản", "I. Ngắn hạn"], ["A. Tài sản", "I. Ngắn hạn", "1. Tiền"], []]


def test_sources(spark, tmp_path):
    place = tmp_path / "aaa" / "2024" / "AAA_2024_hop_nhat"
    place.mkdir(parents=True)
    (place / "x.txt").write_text(REPORT + "năm tài chính kết thúc ngày 31/12/2024", encoding="utf-8")
    r = read_reports(spark, str(tmp_path)).first()
    assert (r["ticker"], r["year"], r["scope"], r["fiscal_year_end"]) == ("AAA", 2024, "consolidated", "31/12/2024")
    bad = path_parts(spark.createDataFrame([("x/y",)], "path string")).first()
    assert not bad["path_ok"]
    assert spark.range(1).select(scope_of(F.lit("bctc_rieng")).alias("s"), fiscal_year_end(F.lit("x")).alias("f")).first()[:] == ("separate", None)
