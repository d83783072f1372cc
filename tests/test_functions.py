import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewright.functions import coerce as c
from sievewright.functions import similarity as s
from sievewright.functions import text as t


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).collect()[0]["y"]


TERMS = [
    ("38. INSECTS - RODENTS - Comments: 5. BAD", "38"), ("03. A X - Comments: q | 1. B Y | 3. C Z", "1,3"), ("33. - Comments: x", None), ("see 12. Abc and 07. Zed", "7,12"),
    (None, None), ("no code", None), ("", None), ("10. A B|2. C D|002. E F", "2,10"), ("00. A B", "0"), ("x COMMENTS: 5. Bad", None), ("1. A Comments: | 99999999999999999999. B C", "1,99999999999999999999"),
]


@pytest.mark.parametrize("text, want", TERMS)
def test_violation_terms(spark, text, want):
    assert one(spark, text, t.violation_terms) == want


@pytest.mark.parametrize("text, want", [("3, 3.7, 0, nan, x, ", [3, 3]), (None, []), ("", []), ("0", []), ("-2.9,inf,1e2,5d", [-2, 100]), ("7\t,\n8", [7, 8])])
def test_parsed_terms(spark, text, want):
    assert one(spark, text, t.parsed_terms) == want


def test_terms_are_worked_out_once(spark):
    plan = spark.createDataFrame([("x",)], "x string").select(t.violation_terms(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1 and plan.count("regexp_replace(") == 1  # that of leading zeros: no pattern to strip


def test_quick_terms_equal_those_of_each_clause(spark):
    draw, bits = random.Random(3), ["1. ", "02. ", "12.", " ", "\u2003", "\n", "|", "|", " - Comments:", "Comments:", " - ", "COMMENTS:", "A", "x", "\u0663. ", "00. ", "7. B", "0", "1234567890123456789. Z"]
    texts = [("".join(draw.choice(bits) for _ in range(draw.randint(0, 8))),) for _ in range(3000)]
    df = spark.createDataFrame(texts, "x string")
    slow = df.select("x", F.array_join(F.filter(F.transform(F.split("x", r"\|", -1), lambda c: t.violation_terms(F.concat(F.lit("(|"), c))), lambda c: c.isNotNull()), ",").alias("y"))  # the clause without a number keeps each from the quick way
    order = lambda y: ",".join(sorted({v for v in y.split(",") if v}, key=lambda v: (len(v), v)))
    got = {r["x"]: r["y"] or "" for r in df.select("x", t.violation_terms(F.col("x")).alias("y")).collect()}
    assert got == {r["x"]: order(r["y"]) for r in slow.collect()}


def test_blanks_are_those_of_unicode(spark):
    df = spark.createDataFrame([(f"{chr(i)}a{chr(i)}b{chr(i)}",) for i in range(0x3100)], "x string")
    assert df.where(c.stripped(F.col("x")) != F.regexp_replace("x", r"(?U)^\s+|\s+$", "")).count() == 0
    assert df.where(F.length(c.stripped(F.col("x"))) == 3).count() == len(c.BLANKS) == 25


def test_ratio_lists_equal_ratios(spark):
    names = [["CUSTOMER1", "CUSTOMER1INC", "UNIT0HOLDINGS", "", "KITTEN"], ["A"], [], ["AB", "BA"]]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n array<string>").select(s.ratio_list(F.col("n"))).collect()]
    pairs = [[(x, y) for i, x in enumerate(n, 1) for y in n[i:]] for n in names]
    assert got == [s.name_ratios(pd.Series([x for x, _ in p]), pd.Series([y for _, y in p])).tolist() for p in pairs]


def test_names_and_labels(spark):
    assert one(spark, "McDonald's #12", t.normalized_name) == "MCDONALDS12" and one(spark, None, t.normalized_name) == ""
    assert one(spark, "\t two  words  \n", c.strip_upper) == "TWO  WORDS"
    assert one(spark, None, c.strip_upper) is None and one(spark, None, c.strip_upper_text) == "NAN" and one(spark, None, c.stripped_text) == "nan"
    assert one(spark, "v" * 31, lambda x: t.count_line(x, F.lit(1234))) == "v" * 27 + "...: 1,234"
    assert one(spark, None, lambda x: t.count_line(x, F.lit(5))) == "NaN: 5"
    assert t.slug("License # Type") == "license_num_type" and t.type_label("bigint") == "int64" and t.type_label("string") == "object"
    assert one(spark, "b,a", lambda x: t.set_text(F.split(x, ","))) == "a, b"
    assert one(spark, 2.0, lambda x: t.stats_line(x, x + 1, x, x), "double") == "Range: [2.00, 3.00], Mean: 2.00, Std: 2.00"


@pytest.mark.parametrize("text, want", [("12", 12.0), (" 1.5 ", 1.5), ("1d", None), ("2F", None), ("NaN", None), ("x", None), (None, None), ("", None), ("1e3", 1000.0)])
def test_numbers(spark, text, want):
    assert one(spark, text, c.to_number) == want


def test_dates(spark):
    rows = spark.createDataFrame([("01/05/2020",), ("1/5/2020",), ("2020-01-05",), (None,), ("13/40/2020",)], "d string")
    assert [tuple(r) for r in c.date_parts(rows, "d", "y", "m", "day").collect()] == [(2020, 1, 5), (2020, 1, 5), (None, None, None), (None, None, None), (None, None, None)]


def test_zip_rates_and_rounding(spark):
    assert one(spark, 60601, c.zip_text, "bigint") == "60601" and one(spark, None, c.zip_text, "bigint") is None
    assert one(spark, None, lambda x: c.zip_text(x, True), "bigint") == "<NA>"
    assert one(spark, 0, lambda x: c.safe_divide(F.lit(1), x), "int") is None and one(spark, 4, lambda x: c.safe_divide(F.lit(1), x), "int") == 0.25
    assert one(spark, 0.00125, lambda x: c.half_even(x, 4), "double") == 0.0012


def test_half_even_as_frames_and_sql(spark):
    values = [3 / 6 * 0.45 + 6 / 8 * 0.3 + 7 / 8 / 7 * 0.15 + 2 / 8 * 0.1, 0.49375, 0.49365, -0.49375, 2.5, 0.0, 1e300, -1e300, float("inf"), None]
    values += [fails / 6 * 0.45 + some / 8 * 0.3 + terms / 8 / 7 * 0.15 + none / 8 * 0.1 for fails in range(7) for some in range(9) for terms in range(0, 60, 7) for none in range(3)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r["y"] for r in rows.select("i", c.half_even(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    assert values[0] < 0.49375 and got[:4] == [0.4938, 0.4938, 0.4936, -0.4938] and got[6:10] == values[6:10]
    assert got == [r[0] for r in duckdb.execute("select round_even(x, 4) from (select unnest(?::double[]) x)", [values]).fetchall()]


def test_fills_and_drops(spark):
    df = spark.createDataFrame([("a", None, 0), (None, "b", 1), (None, None, None)], "x string, `y #` string, z int")
    assert [r["x"] for r in c.fill_from(df, "x", "y #").collect()] == ["a", "b", None]
    assert [r["x"] for r in c.fill_constants(df, {"x": "?", "gone": 1}).collect()] == ["a", "?", "?"]
    assert c.drop_equal(df, "z", 0).count() == 2 and c.drop_null_rows(df, "x", "z").count() == 1 and c.drop_present(df, "z", "gone").columns == ["x", "y #"]
    assert [r["x"] for r in c.missing_to_null(spark.createDataFrame([("NA",), ("n/a",), ("ok",), ("",)], "x string")).collect()] == [None, None, "ok", None]


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABC1") for _ in range(rng.randrange(25))) for _ in range(2))
        assert s.lcs_length(a, b) == dp(a, b)
    assert s.name_ratios(pd.Series(["KITTEN", "", "SAME"]), pd.Series(["SITTING", "X", "SAME"])).tolist() == [0.62, 0.0, 1.0]


@pytest.mark.parametrize("metres, want", [(0.0, 1.0), (100.0, 0.9), (300.0, 0.75), (500.0, 0.6), (2750.0, 0.15), (5000.0, 0.0), (5001.0, 0.0)])
def test_distance_curve(spark, metres, want):
    assert math.isclose(one(spark, metres, s.distance_similarity, "double"), want, abs_tol=1e-12)


def test_places_and_codes(spark):
    row = spark.createDataFrame([(41.0, -87.0, 41.0, -88.0, None)], "a double, b double, c double, d double, n double")
    got = row.select(s.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("far"), s.place_similarity(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("same"), s.place_similarity(F.col("a"), F.col("b"), F.col("n"), F.col("b")).alias("none")).collect()[0]
    assert math.isclose(got["far"], 83917, rel_tol=1e-3) and got["same"] == 1.0 and got["none"] == 0.0
    codes = spark.createDataFrame([("1", "1", " Cafe", "CAFE "), (None, None, "", " "), ("1", "2", None, "x")], "a string, b string, x string, y string")
    assert [tuple(r) for r in codes.select(s.same_code(F.col("a"), F.col("b")), s.same_category(F.col("x"), F.col("y"))).collect()] == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    assert one(spark, 0.0, lambda x: s.score(x, F.lit(1.0), F.lit(1.0), F.lit(1.0)), "double") == pytest.approx(0.45)
