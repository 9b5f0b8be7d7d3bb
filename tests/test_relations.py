import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellquarry.operators import answers, quality, questions, ranking, search, synthesis, tables
from cellquarry.sources.io import write_package
from cellquarry.streaming.ingest import Conflict, KeyedTable

DATA = "/root/testdata/sf0.001"


def ranked(spark, lists, qid=1):
    return spark.createDataFrame([(qid, s, r, i + 1) for s, refs in enumerate(lists) for i, r in enumerate(refs)], "qid int, source int, ref string, rank int")


def refs(df):
    return [r["ref"] for r in df.orderBy("rank").collect()]


def test_fusion_and_round_robin(spark):
    out = ranking.reciprocal_rank_fusion(ranked(spark, [["A", "A", "B"], ["B", "A"]]), 0).orderBy("rank").collect()
    assert [(r["ref"], round(r["score"], 4)) for r in out] == [("A", 1.5), ("B", 1.3333)]
    turns = ranked(spark, [["A1", "A2"], ["B1", "B2"]]).withColumnRenamed("source", "route")
    assert refs(ranking.round_robin(turns, 3)) == ["A1", "B1", "A2"]
    with pytest.raises(ValueError):
        ranking.reciprocal_rank_fusion(turns, -1)


def manifest(spark, rows):
    return spark.createDataFrame(rows, "table_ref string, ticker string, report_year int, scope string")


@pytest.mark.parametrize("rows, scope, policy, want", [
    ([("t1", "A", 1, "separate"), ("t2", "A", 1, "consolidated"), ("t3", "A", 1, "consolidated")], None, "consolidated", ["t2", "t3"]),
    ([("t1", "A", 1, "separate"), ("t2", "A", 1, "consolidated")], "separate", "consolidated", ["t1"]),
    ([("t1", "A", 1, "separate")], None, "consolidated", ["t1"]),
    ([("t1", "A", 1, "separate"), ("t2", "B", 1, "separate"), ("t3", "A", 1, "consolidated")], None, "consolidated", ["t2", "t3"]),
    ([("t1", "A", 1, "unknown"), ("t2", "A", 1, "consolidated")], None, "consolidated", ["t1", "t2"]),
    ([("t1", "A", 1, "separate"), ("t2", "A", 1, "consolidated")], None, "both", ["t1", "t2"]),
])
def test_scope_filter(spark, rows, scope, policy, want):
    r = ranked(spark, [[x[0] for x in rows]]).withColumn("scope", F.lit(scope).cast("string"))
    assert refs(ranking.scope_filter(r, manifest(spark, rows), policy)) == want


def test_unknown_refs_survive_and_coverage(spark):
    r = ranked(spark, [["gone", "t1"]]).withColumn("scope", F.lit(None).cast("string"))
    assert refs(ranking.scope_filter(r, manifest(spark, [("t1", "A", 1, "consolidated")]), "consolidated")) == ["gone", "t1"]
    names = {"extra": ("A", 2024), "a23": ("A", 2023), "a24": ("A", 2024), "b23": ("B", 2023), "b24": ("B", 2024)}
    m = manifest(spark, [(k, t, y, "separate") for k, (t, y) in names.items()])
    hits = ranked(spark, [list(names)]).withColumn("score", 1.0 / F.col("rank")).select("qid", "ref", "score", "rank")
    routes = ranking.routes(spark.createDataFrame([(1, ["B", "A"], [2024, 2023])], "qid int, tickers array<string>, years array<int>")).withColumn("scopes", F.array().cast("array<string>"))
    assert refs(ranking.keep_coverage(hits, routes, m, 4)) == ["extra", "a23", "b23", "b24"]


def test_search(spark):
    docs = spark.createDataFrame([("a", "Doanh thu thuần\ndoanh thu thuan"), ("b", "Tổng tài sản\ntong tai san"), ("c", "Tài sản tài sản tài sản")], "doc string, text string")
    index = search.build_index(docs, "doc", "text")
    ask = lambda q, allowed=None: [r["doc"] for r in search.search(index, spark.createDataFrame([(1, q)], "qid int, text string"), 1, allowed).collect()]
    only_b = spark.createDataFrame([(1, "b")], "qid int, doc string")
    assert ask("doanh thu thuan") == ["a"] and ask("tài sản") == ["c"] and ask("tài sản", only_b) == ["b"] and ask("nothing") == []
    with pytest.raises(ValueError):
        search.build_index(docs.limit(0), "doc", "text")


def test_questions(spark):
    companies = spark.createDataFrame([("FPT", "CTCP FPT"), ("FTS", "CTCP Chứng khoán FPT"), ("HPG", "CTCP Tập đoàn Hòa Phát"), ("POW", "Tổng Công ty Điện lực Dầu khí Việt Nam"), ("GAS", "Tổng Công ty Khí Việt Nam")], "ticker string, name string")
    asked = [(1, "Doanh thu của Hòa Phát năm 2020-2024 là bao nhiêu tỷ đồng?"), (2, "Lợi nhuận của FPT đầu năm 2019?"), (3, "Vốn của công ty mẹ theo báo cáo riêng"), (4, "Doanh thu của Chứng khoán FPT năm 2021?")]
    specs = {r["qid"]: r for r in questions.query_specs(spark.createDataFrame(asked, "qid int, question string"), companies).collect()}
    assert [e["ticker"] for e in specs[1]["entities"]] == ["HPG"] and sorted(p["year"] for p in specs[1]["periods"]) == [2020, 2021, 2022, 2023, 2024]
    assert specs[1]["target_unit"] == "BILLION_VND" and specs[1]["target_divisor"] == 1e9
    assert [e["ticker"] for e in specs[2]["entities"]] == ["FPT"] and specs[2]["periods"][0]["column_role"] == "prior_period"
    assert specs[3]["entities"] == [] and [e["ticker"] for e in specs[4]["entities"]] == ["FTS"]


def test_word_set_score():
    r = np.random.default_rng(8)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = following(row, x, b)
        return row[-1]

    def following(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    for _ in range(200):
        a, b = ("".join(r.choice(list("ab c"), int(r.integers(0, 90)))) for _ in range(2))
        want = 2 * longest(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert questions.indel_ratio(a, b) == pytest.approx(want)
    assert questions.token_set_score("doanh thu fpt", "fpt") == 100 and questions.token_set_score("", "fpt") == 0


def test_metrics_and_allocation(spark):
    got = spark.range(1).select(quality.f_beta(F.array(F.lit("g"), F.lit("x")), F.array(F.lit("g"))).alias("m"), quality.within_tolerance(F.lit("10"), F.lit("10.01")).alias("a"), quality.within_tolerance(F.lit("10"), F.lit("10.011")).alias("b"), quality.within_tolerance(F.lit("x"), F.lit("1")).alias("c")).first()
    assert tuple(got["m"]) == (0.5, 1.0, pytest.approx(5 / 6)) and (got["a"], got["b"], got["c"]) == (True, False, False)
    sizes = dict(zip(["1", "2", "3", "4", "5", "6", "7", "8+"], [441, 141, 119, 127, 76, 34, 14, 60], strict=True))
    seats = quality.largest_remainder(spark.createDataFrame(list(sizes.items()), "stratum string, n int"), 200)
    assert {r["stratum"]: r["seats"] for r in seats.collect()} == dict(zip(sizes, [87, 28, 23, 25, 15, 7, 3, 12], strict=True))


def test_answers(spark):
    rows = spark.createDataFrame([(1, "Chênh lệch doanh thu?", -12.5, "df1"), (2, "Doanh thu giảm bao nhiêu?", -3.0, "df1")], "id int, question string, answer double, pandas_query string")
    once = answers.unsigned_differences(rows)
    assert [(r["answer"], r["pandas_query"]) for r in answers.unsigned_differences(once.drop("changed")).orderBy("id").collect()] == [(12.5, "abs(df1)"), (-3.0, "df1")]
    with pytest.raises(Exception, match="no position"):
        answers.retarget(spark.createDataFrame([("odd",)], "table_ref string"), "ordinal").collect()
    cells = spark.createDataFrame([(1, "df1", 0, 1, "Tổng cộng", "2018", None, None, "VND"), (1, "df1", 1, 1, "Lãi tiền gửi", "2018", 7.0, 7e6, "MILLION_VND"), (1, "df1", 1, 2, "Lãi tiền gửi", "2017", 9.0, 9e6, "MILLION_VND")], "qid int, variable string, row_index int, column_index int, row_label string, column_label string, numeric_value double, base_value double, source_unit string")
    asked = spark.createDataFrame([(1, "Lãi tiền gửi năm 2018", [2018], 1e6)], "qid int, question string, years array<int>, target_divisor double")
    best = answers.best_cells(cells, asked)
    assert answers.fallback_answers(best, asked.select("qid", "target_divisor")).first()["answer"] == 7.0
    assert answers.best_cells(cells.where("numeric_value is null"), asked).count() == 0


def test_runs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, answer int")
    base, other = frame([(1, 1), (2, 2), (3, 3)]), frame([(1, 10), (3, 30)])
    assert [tuple(r) for r in quality.overlay(base, other, frame([(1, 0), (3, 0)])).collect()] == [(1, 10), (2, 2), (3, 30)]
    with pytest.raises(ValueError):
        quality.overlay(base, other, frame([(1, 0)]))
    with pytest.raises(ValueError, match="repeated"):
        quality.merge_shards([base, other])
    with pytest.raises(ValueError):
        quality.check_fingerprints(["a", "b"], [0, 1])


def test_conditions(spark):
    gates = [(1, label, v, 15.0) for label, v in zip(["Phải trả người bán", "▪ Phải trả người bán", "Phải trả người bán (*)", "Phải trả người bán"], [10.0, 30.0, 20.0, 40.0], strict=True)] + [(2, "a", 1.0, 0.5), (2, "b", 2.0, 0.5)]
    got = synthesis.recover_conditions(spark.createDataFrame(gates, "id int, row_label string, base_value double, threshold double")).collect()
    assert [tuple(r) for r in got] == [(1, "Phải trả người bán", 3, 4)]


def test_keyed_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, "id", "v1")
    rows = lambda *xs: spark.createDataFrame(xs, "id int, x string")
    table.add(rows((2, "b"), (1, "a")))
    KeyedTable(spark, path, "id", "v1").add(rows((2, "b"), (3, None)))
    assert [tuple(r) for r in table.consolidate().collect()] == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(Conflict):
        table.add(rows((1, "z")))
    with pytest.raises(Conflict):
        KeyedTable(spark, path, "id", "v2")


def test_package(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/one.csv").write_text("x")
    rows = [{"id": 1, "evidence": [{"variable": "df1", "csv_path": "data/one.csv"}]}]
    assert write_package(rows, tmp_path, tmp_path / "out.zip") == ["submission.json", "data/one.csv"]
    with pytest.raises(FileExistsError):
        write_package(rows, tmp_path, tmp_path / "out.zip")
    assert json.dumps(rows)


def test_as_of_is_inclusive(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1)], "key string, at int")
    right = spark.createDataFrame([("k", 5, "x"), ("k", 7, "y")], "key string, at int, v string")
    assert {(r["at"], r["v"]) for r in tables.as_of(left, right, "key", "at", "v").collect()} == {(5, "x"), (1, None)}


@pytest.mark.parametrize("name", ["unit_resolution", "rank_fusion", "scope_routing", "program_columns", "run_comparison", "count_profile", "seat_allocation"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents embeddings benchmark labels".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    flat = lambda v: round(v, 4) if isinstance(v, float) else v
    want = sorted(tuple(flat(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(flat(v) for v in r) for r in got.collect()) == want


def test_positions_of_many_rows_with_payload(spark):
    df = spark.range(120_000).select((F.xxhash64("id") % 1000).alias("k"), F.col("id"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("p")).repartition(7)
    out = ranking.global_index(df, "k", "id")
    facts = out.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index")).first()
    assert tuple(facts) == (120_000, 120_000, 0, 119_999)
    pairs = out.select("index", F.struct("k", "id").alias("s")).orderBy("index").limit(500).collect()
    assert [tuple(x["s"]) for x in pairs] == sorted(tuple(x["s"]) for x in pairs)
    parts = [ranking.shard(df.select("id"), "id", 3, i).count() for i in range(3)]
    assert parts == [40_000] * 3 and ranking.limited_shard(df.select("id"), "id", 10, 3, 0).count() == 4
    with pytest.raises(ValueError):
        ranking.limited_shard(df, "id", 0, 3, 0)


def test_dense_index_counts_its_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc int, vector array<double>")
    search.DenseIndex(v, 2).save(f"file://{tmp_path}/good")
    assert search.DenseIndex.load(spark, f"file://{tmp_path}/good").documents == 2
    search.DenseIndex(v, 3).save(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="expected"):
        search.DenseIndex.load(spark, f"file://{tmp_path}/bad")


def test_spans_reach_as_far_as_the_table():
    wide = tables.to_matrix("<table><tr><td colspan=1500>a</td></tr><tr><td rowspan=9>b</td><td>c</td></tr><tr><td>d</td></tr></table>")
    assert len(wide[0]) == 1500 and wide[0][1499] == "a" and [r[:2] for r in wide[1:]] == [["b", "c"], ["b", "d"]]


def test_shared_folder_is_needed_off_one_machine():
    from types import SimpleNamespace

    from cellquarry.sources.shared import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(far)


@pytest.mark.parametrize("name", ["text_idioms", "array_and_json_idioms", "company_aliases", "company_mentions", "asked_companies", "frame_programs", "finalized_predictions", "stratified_subset", "line_positions"])
def test_more_queries_match_sql(spark, name):
    test_queries_match_sql(spark, name)
