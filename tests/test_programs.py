import json
import random

import pytest

from cellquarry.plans import nodes as n
from cellquarry.plans.bind import Fact, answer_with_year, bind, check_coverage, plausible, run_batch, snap
from cellquarry.plans.evaluate import evaluate, to_column
from cellquarry.plans.interchange import check_text, evaluate_text, text_to_column, to_text
from cellquarry.plans.typing import dimension_of
from cellquarry.plans.wire import json_schema, parse, root_allowed, to_dict, to_json

L = lambda *xs: [n.literal(x) for x in xs]


def value(node):
    return evaluate(node, lambda c: None)


def test_values():
    assert value(n.aggregate("mean", L(2, 4, 6))) == 4
    assert value(n.count_if(L(-1, 2, 3), ">", n.literal(0))) == 2
    assert value(n.arg_extremum("argmax", L(3, 8, 5), L(30, 80, 50))) == 80
    assert value(n.arg_extremum("argmax", L(8, 8), L(1, 2))) == 1
    three = [(L(1, 1, 2), ">", n.literal(0)), (L(1, -1, 2), ">", n.literal(0))]
    assert value(n.select("sum", L(10, 20, 30), three)) == 40
    assert value(n.select("median", L(5, 1, 4, 2, 3))) == 3
    assert value(n.select("argmax", L(30, 10, 20))) == 30 and value(n.select("argmin", L(30, 10, 20))) == 10
    assert value(n.select("max", L(1, 2), [(L(1, 2), ">", n.literal(9))])) is None
    assert value(n.binary("/", n.literal(1), n.literal(0))) is None


def test_dimensions():
    c = lambda d: n.cell("df1", 0, 1, dimension=d)
    assert dimension_of(n.binary("/", c("VND"), c("VND"))) == "RATIO"
    for op, a, b in (("+", "VND", "PERCENT"), ("*", "VND", "VND"), ("/", "DIMENSIONLESS", "VND")):
        with pytest.raises(n.ProgramError):
            dimension_of(n.binary(op, c(a), c(b)))
    assert dimension_of(n.select("count", [c("VND")])) == "COUNT"


def random_program(r, depth=3):
    if depth == 0 or r.random() < 0.25:
        return n.literal(r.randint(-9, 9))
    sub = lambda k: [random_program(r, depth - 1) for _ in range(k)]
    k = r.randint(1, 3)
    return r.choice([
        lambda: n.binary(r.choice("+-*/"), *sub(2)), lambda: n.aggregate(r.choice(["sum", "mean", "min", "max"]), sub(k)), lambda: n.count_if(sub(k), r.choice(n.COMPARATORS), *sub(1)),
        lambda: n.arg_extremum(r.choice(["argmin", "argmax"]), sub(k), sub(k)), lambda: n.select(r.choice(["sum", "mean", "min", "max", "count", "argmin", "argmax"]), sub(k), [(sub(k), r.choice(n.COMPARATORS), r.choice([sub(k), *sub(1)]))]), lambda: n.select("median", sub(k)),
    ])()


def test_forms_agree(spark):
    r = random.Random(4)
    programs = [random_program(r, 2) for _ in range(25)]
    for p in programs:
        assert to_dict(parse(to_json(p))) == to_dict(p)
    same = spark.range(1).select(*[to_column(p, None).cast("double").alias(f"c{i}") for i, p in enumerate(programs)]).first()
    for got, p in zip(same, programs, strict=True):
        want = value(p)
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9), to_json(p)
    plain = [p for p in programs if value(p) is not None and len(to_text(p)) < 4000][:8]
    again = spark.range(1).select(*[text_to_column(to_text(p), set(), None).cast("double").alias(f"c{i}") for i, p in enumerate(plain)]).first()
    for got, p in zip(again, plain, strict=True):
        assert got is None or abs(got - value(p)) < 1e-9, to_text(p)


@pytest.mark.parametrize("raw", [
    {"kind": "literal", "value": float("nan"), "dimension": "VND"}, {"kind": "cell", "variable": "../../x", "row_index": 0, "column_index": 0},
    {"kind": "literal", "value": 1, "dimension": "VND", "more": 1}, {"kind": "arg_extremum", "mode": "argmax", "keys": [{"kind": "literal", "value": 1, "dimension": "VND"}], "values": []}, {"kind": "?"},
])
def test_refused(raw):
    with pytest.raises(n.ProgramError):
        parse(raw)


def test_limits():
    node = n.literal(1)
    for _ in range(20):
        node = n.binary("+", node, n.literal(1))
    assert parse(to_json(node))
    with pytest.raises(n.ProgramError):
        parse(to_json(n.binary("+", node, n.literal(1))))
    assert parse(to_json(n.aggregate("sum", L(*range(100)))))
    with pytest.raises(n.ProgramError):
        parse(to_json(n.aggregate("sum", L(*range(101)))))
    assert root_allowed("select", "YEAR", "year") and not root_allowed("select", "YEAR", "strict") and json_schema()["$defs"]["node"]


def test_binding():
    facts = {("df1", 0, 1): [Fact("MILLION_VND", 7.0, 7e6, "AAA", 2022, "Số đầu năm")], ("df1", 0, 2): [Fact("MILLION_VND", None, None, "AAA", 2022, "x")], ("df1", 1, 1): [Fact("PERCENT", 5.0, 5.0, "AAA", 2022, "x")]}
    at = lambda node: getattr(facts[node["variable"], node["row"], node["column"]][0], node["value"])
    bound, dim = bind(n.cell("df1", 0, 1, "numeric_value"), ["df1"], facts, "MILLION_VND", 1e6)
    assert dim == "VND" and evaluate(bound, at) == 7.0
    assert bind(n.cell("df1", 1, 1), ["df1"], facts, "PERCENT", 1.0)[0]["value"] == "numeric_value"
    with pytest.raises(n.ProgramError, match="holds numbers at c1"):
        bind(n.cell("df1", 0, 2), ["df1"], facts, "VND", 1.0)
    assert evaluate(bind(n.cell("df1", 0, 2), ["df1"], facts, "VND", 1.0, lenient=True)[0], at) == 7e6
    assert snap(n.cell("df1", 0, 2), facts)["column"] == 1
    check_coverage(n.cell("df1", 0, 1), facts, ["AAA"], [2021, 2022])
    with pytest.raises(n.ProgramError) as e:
        check_coverage(n.cell("df1", 0, 1), facts, ["BBB"], [])
    assert e.value.soft and e.value.code == "MISSING_TICKERS"
    assert not plausible(n.binary("-", n.cell("df1", 0, 1), n.cell("df1", 0, 1)), 0.0) and plausible(n.cell("df1", 0, 1), 0.0)


def test_year_answers():
    cells = [n.cell(f"df{i}", 0, 1) for i in (1, 2, 3)]
    years = {"df1": 2021, "df2": 2022, "df3": 2023}
    got = answer_with_year(n.select("argmax", cells), "YEAR", years)
    assert [x["value"] for x in got.group("items")] == [2021, 2022, 2023] and got.group("keys") == tuple(cells)
    for node, target in ((n.select("max", cells), "YEAR"), (n.select("argmax", cells), "VND"), (n.select("argmax", [cells[0], cells[0]]), "YEAR")):
        assert answer_with_year(node, target, years) is node


def test_sandbox(spark):
    for text in ("__import__('os')", "df1.__class__", "open('x')", "[x for x in df1]", "not 1", "1 // 2"):
        with pytest.raises(n.ProgramError):
            check_text(text, {"df1"})
    with pytest.raises(n.ProgramError):
        text_to_column("1 < 2", set(), None)
    got = spark.range(1).select(text_to_column("(_v0 := 3 + 1, _v0 * 2)[-1]", set(), None).alias("x")).first()["x"]
    assert got == 8.0


def test_batch(spark):
    rows = [("t1", "d", "AAA", 2024, "separate", "MILLION_VND", 0, 1, "Tiền", "2024", "7", 7.0, 7e6, False, False)]
    from cellquarry.sources.io import CELLS

    cells = spark.createDataFrame(rows, CELLS)
    ok, bad = to_json(n.cell("df1", 0, 1)), json.dumps({"kind": "?"})
    programs = spark.createDataFrame([(1, ok, "MILLION_VND", 1e6, ["AAA"], [2024]), (2, bad, "VND", 1.0, [], []), (3, ok, "VND", 1.0, ["BBB"], [])], "id long, program string, target_unit string, target_divisor double, tickers array<string>, years array<int>")
    got = {r["id"]: (r["answer"], r["error"]) for r in run_batch(programs, spark.createDataFrame([(i, "df1", "t1") for i in (1, 2, 3)], "id long, variable string, table_ref string"), cells).collect()}
    assert got == {1: (7.0, None), 2: (None, "SHAPE"), 3: (None, "MISSING_TICKERS")}


def test_bound_text_and_both_readers_agree(spark):
    r = random.Random(9)
    programs = [random_program(r, 2) for _ in range(40)]
    for p in programs:
        for bound in (False, True):
            got, want = evaluate_text(to_text(p, bound), {}), value(p)
            assert want is None or abs(got - want) < 1e-9, to_text(p, bound)
    cells = [n.cell(f"df{i}", 0, 1) for i in range(1, 101)]
    wide = to_text(n.select("median", cells), bound=True)
    with pytest.raises(n.ProgramError, match="characters"):
        to_text(n.select("median", cells))
    frames = {f"df{i}": [{"row_index": 0, "column_index": 1, "base_value": float(i * 37 % 101)}] for i in range(1, 101)}
    assert len(wide) < 200_000 and evaluate_text(wide, frames) == 50.5


FRAME = [("A", 0, 3.0), ("B", 1, None), ("B", 2, 8.5), ("A", 3, 1.0)]


@pytest.mark.parametrize("text, want", [
    ("df1['v'].sum()", 12.5), ("sum(df1['v'])", None), ("df1['v'].mean()", 12.5 / 3), ("df1['v'].fillna(1).mean()", 13.5 / 4), ("df1['v'].median()", 3.0), ("df1['v'].min() + df1['v'].max()", 9.5),
    ("df1.loc[df1['k'] == 'B', 'v'].sum()", 8.5), ("df1.loc[(df1['k'] == 'B') & (df1['i'] > 1), 'v'].item()", 8.5), ("df1.loc[(df1['i'] == 0) | (df1['i'] == 3), 'v'].iloc[-1]", 1.0), ("df1['v'].iloc[9]", None),
    ("float(df1.loc[df1['k'] == 'Z', 'v'].sum())", 0.0), ("df1.loc[df1['k'] == 'Z', 'v'].mean()", None), ("len(df1['v'])", 4.0), ("df1['v'].round(0).sum()", 12.0), ("max(df1.loc[df1['i'] > 1, 'v'])", 8.5), ("df1['v'].astype(float).max()", 8.5),
    ("df1.loc[df1['k'] == 'B', 'v'].item()", None), ("7 % 4 + 2 ** 3", 11.0), ("1 / 0", None), ("(3 if 1 < 2 and not_there else 4)", "refused"), ("df1", "refused"), ("df1['v']", "refused"), ("df2['v'].sum()", "refused"), ("df1['v'].std()", "refused"),
])
def test_frame_methods(spark, text, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([{"k": k, "i": i, "v": v} for k, i, v in FRAME],)], "rows array<struct<k: string, i: int, v: double>>")
    frames = {"df1": [{"k": k, "i": i, "v": v} for k, i, v in FRAME]}
    if want == "refused":
        with pytest.raises(n.ProgramError):
            evaluate_text(text, frames)
        with pytest.raises(n.ProgramError):
            text_to_column(text, {"df1"}, frames=lambda _: F.col("rows"))
        return
    got = df.select(text_to_column(text, {"df1"}, frames=lambda _: F.col("rows")).alias("x")).first()["x"]
    for found in (got, evaluate_text(text, frames)):
        assert found is None if want is None else found == pytest.approx(want)
