from pyspark.sql import functions as F

from cellquarry.functions import numbers, text, units


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_numbers(spark):
    cases = {
        "1.071.561.008.455": 1071561008455.0, "(1.234.567)": -1234567.0, "1.234,56": 1234.56, "1,234.56": 1234.56, "12,5%": 12.5, "-": 0.0, "1O0.000": None,
        "1,234": 1.234, "1,234,567": None, "12.34": 12.34, "1.234": 1234.0, "1.2345": 1.2345, "(-5)": 5.0, "1.000 VND": 1000.0, "1 000 đồng": 1000.0, "": None, None: None, "9" * 400: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", numbers.parse_number(F.col("raw")).alias("n"))
    got = {r["raw"]: r["n"] for r in df.collect()}
    assert {k: v["value"] for k, v in got.items()} == cases
    assert [k for k, v in got.items() if v["is_dash"]] == ["-"] and [k for k, v in got.items() if v["is_percent"]] == ["12,5%"]
    assert {k for k, v in got.items() if v["is_missing"]} == {"", None}


def test_units(spark):
    cases = {
        "Don vi: trieu USD": "MILLION_USD", "Currency: USD": "USD", "Số cổ phần": "SHARES", "Số lượng cổ phiếu đang lưu hành": "SHARES", "Giá trị cổ phần": "UNKNOWN",
        "Lãi cơ bản trên mỗi cổ phiếu (đồng/cổ phiếu)": "VND", "Lãi cơ bản (nghìn đồng/cổ phiếu)": "THOUSAND_VND", "đồng": "VND", "Công ty Đông Á": "BILLION_VND", None: "UNKNOWN",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", units.detect_unit(F.col("x")).alias("u"))
    assert {r["x"]: r["u"] for r in df.collect()} == cases
    cell = lambda table, row, col: one(spark, units.cell_unit(F.lit(table), F.lit(row), F.lit(col)))
    assert cell("MILLION_VND", 'US Dollar ("USD")', "Closing balance") == "USD"
    assert cell("VND", "Công ty A", "Tỷ lệ vốn") == "PERCENT"
    assert cell("MILLION_VND", "Lợi nhuận phân bổ cho cổ đông sở hữu cổ phiếu phổ thông", "Năm 2024") == "MILLION_VND"
    heads = lambda *h: one(spark, units.table_unit(F.array().cast("array<string>"), F.array(*map(F.lit, h)), F.lit(None).cast("string")))
    assert heads("Năm 2024 VND", "Năm 2023 VND") == "VND" and heads("Tỷ lệ %", "Số lượng cổ phiếu") == "UNKNOWN"
    assert one(spark, units.is_declaration(F.lit("Đơn vị tính: VND"))) and not one(spark, units.is_declaration(F.lit("Phát hành cổ phiếu trị giá 10 đồng")))
    assert one(spark, units.to_base(F.lit(2.5), F.lit("MILLION_USD"))) == 2500000.0


def test_targets(spark):
    cases = {"là bao nhiêu nghìn tỷ đồng?": "TRILLION_VND", "bao nhiêu triệu cổ phiếu": "MILLION_SHARES", "năm nào lớn nhất": "YEAR", "tăng bao nhiêu %": "PERCENT", "bao nhiêu công ty có lãi": "COUNT", "gấp bao nhiêu lần": "RATIO", "xin chào": "UNKNOWN"}
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", units.detect_target(F.col("q"))["unit"].alias("u"))
    assert {r["q"]: r["u"] for r in df.collect()} == cases


def test_text(spark):
    assert one(spark, text.ascii_words(F.lit("  Đơn  vị\ttính: TRIỆU đồng "))) == "don vi tinh: trieu dong"
    assert one(spark, text.ascii_compact(F.lit("Số cổ phần"))) == "socophan"
    assert one(spark, text.normalize_text(F.col("x")), x="á &amp; b") == "á & b"
    for plain in ("Doanh thu thuần đạt 5 tỷ đồng", "naïve – “café” €", "ĐÃ”", "Spaß“ x", "é", "Â giá"):
        misread = plain.encode().decode("latin-1")
        assert text.tidy(misread) == text.tidy(plain)
    assert one(spark, text.normalize_text(F.col("x")), x="Lợi nhuận\nnÄƒm") == "Lợi nhuận năm" and text.tidy("ĐÃ” Spaß“") == 'ĐÃ" Spaß"'
    assert one(spark, text.usable_section(F.lit("10 $^{th}$ Floor"))) == "" and one(spark, text.usable_section(F.lit("5. Tiền"))) == "5. Tiền"
    assert one(spark, text.has_titled(F.lit("Lãi của Hoa Phat"), F.lit("hoa phat"))) and not one(spark, text.has_titled(F.lit("hoa phat"), F.lit("hoa phat")))
    assert one(spark, text.trim_to_question(F.lit("Doanh thu năm 2024 của công ty là bao nhiêu? Giải thích."))).endswith("?")
    assert one(spark, numbers.python_mod(F.lit(-3), F.lit(5))) == 2
