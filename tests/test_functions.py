"""Scalar rules on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from skysift.functions import numbers, sky, text


def one(spark, expr, **values):
    names = list(values) or ["x"]
    ddl = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double'}" for n, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], ddl).select(expr.alias("out")).first()["out"] if names else None


@pytest.mark.parametrize(
    "raw, number, binary",
    [("", None, 0), ("nan", None, 0), ("N/A", None, 0), (" 1.5 ", 1.5, 0), ("1,000", None, 0), ("Yes", None, 1),
     ("1.0", 1.0, 0), ("1", 1.0, 1), ("selected", None, 1), (None, None, 0), ("\t7\n", 7.0, 0), ("inf", math.inf, 0)],
)
def test_parse(spark, raw, number, binary):
    assert one(spark, text.parse_float("x"), x=raw) == number
    assert one(spark, text.parse_binary("x"), x=raw) == binary


@pytest.mark.parametrize("raw, whole", [("3.9", 3), ("-3.9", -3), ("x", 0), ("", 0), ("nan", 0), ("inf", 0), (None, 0), ("1e30", 0)])
def test_safe_int(spark, raw, whole):
    assert one(spark, text.safe_int("x"), x=raw) == whole


@pytest.mark.parametrize(
    "name, base, plain",
    [("x", "x", "x"), ("x.jpg", "x.jpg", "x"), ("/p/X.JPG", "X.JPG", "X"), (" a.b.png ", "a.b.png", "a.b"), ("/p/", "", ""),
     (".hidden", ".hidden", ".hidden")],
)
def test_names(spark, name, base, plain):
    assert one(spark, text.base_name("x"), x=name) == base
    assert one(spark, text.stem(text.base_name("x")), x=name) == plain


def test_name_keys(spark):
    assert one(spark, text.name_keys("x"), x="/p/X.JPG") == ["/p/X.JPG", "X.JPG", "X", "/p/x.jpg", "x.jpg", "x"]
    assert one(spark, text.name_keys("x"), x="x") == ["x"]


def test_first_value(spark):
    df = spark.createDataFrame([("", None, "b")], "Name string, filename string, FileName2 string")
    assert df.select(text.first_non_empty(df, "filename", "name", "filename2").alias("v")).first()["v"] == "b"
    assert df.select(text.first_present(df, "filename", "name").alias("v")).first()["v"] == ""
    assert df.select(text.first_non_empty(df, "other", default="d").alias("v")).first()["v"] == "d"


def test_normalize_text(spark):
    assert one(spark, text.normalize_text("x"), x="SDSS J12.05 É ﬁ\n") == "sdssj1205éfi"
    assert one(spark, text.normalize_text("x"), x=None) == ""


def test_search_keys(spark):
    keys = one(spark, text.search_keys("x"), x="SDSS J120540.43+491029.3")
    assert "j12054043+4910293" in keys and "j120540+491029" in keys and len(keys) == 6
    assert one(spark, text.search_keys("x"), x="NAME Knot in M87 Jet") == ["knotinm87jet"]
    assert one(spark, text.search_keys("x"), x="NAME M87") == []  # stripped name below four characters
    assert one(spark, text.search_keys("x"), x="Abel") == []  # key below six characters
    assert one(spark, text.search_keys("x"), x=None) == []
    two = one(spark, text.search_keys("x"), x="SLACS J1205+4910 and J0123-45")
    assert {"j1205+4910", "j0123-45", "j1205+4910andj0123-45"} <= set(two)


def test_phrases(spark):
    got = one(spark, text.phrases("x"), x="SLACS SDSS J120540.43+491029.3 source")
    assert set(got) == {"J120540.43+491029.3", "J1205+4910", "J120540+491029", "SDSS J120540.43+491029.3"}
    assert one(spark, text.phrases("x"), x="abc") == []
    assert one(spark, text.clean_phrase("x"), x=' a"b\\c ') == "abc"


@pytest.mark.parametrize("code, year", [("1998ApJ", "1998"), ("ApJ1998", ""), ("19", "19"), ("", "")])
def test_year(spark, code, year):
    assert one(spark, text.year_of("x"), x=code) == year


def test_year_number(spark):
    assert one(spark, text.year_number("x"), x="in press") == 0
    assert one(spark, text.year_number("x"), x="2004") == 2004


def test_links(spark):
    assert one(spark, text.survey_link("a", "b"), a=0.0, b=0.0) == ""
    assert "ra=1.5&dec=-2.0" in one(spark, text.survey_link("a", "b"), a=1.5, b=-2.0)
    assert one(spark, text.paper_link("x"), x="1998A&A...1") == "https://ui.adsabs.harvard.edu/abs/1998A%26A...1/abstract"
    assert one(spark, text.paper_link("x"), x="") == ""


def test_expert_name(spark):
    assert one(spark, text.expert_name("x"), x="/d/expert_scores_Ann.csv") == "Ann"
    assert one(spark, text.expert_name("x"), x="/d/expert_scores_.csv") == "Unknown"
    assert one(spark, text.expert_name("x"), x="/d/Bob.csv") == "Bob"


@pytest.mark.parametrize("v, out", [(45.0, 0.45), (0.45, 0.45), (1.0, 1.0), (250.0, 1.0), (-3.0, 0.0)])
def test_fraction(spark, v, out):
    assert one(spark, numbers.fraction("x"), x=v) == pytest.approx(out)


def test_tiers(spark):
    assert [one(spark, numbers.score_tier("x", 10.0), x=v) for v in (7.0, 6.9, 4.0, 3.9)] == ["high", "middle", "middle", "low"]
    assert one(spark, numbers.score_tier("x", 0.0), x=1.0) == "none"
    assert [one(spark, numbers.expert_tier("x"), x=v) for v in (0.4, 0.1, 0.0)] == ["high", "middle", "low"]
    assert one(spark, numbers.expert_tier("x", 0.5, True), x=0.5) == "middle"
    assert [one(spark, numbers.sum_tier("x"), x=v) for v in (35.0, 20.0, 19.0)] == ["high", "middle", "low"]


@pytest.mark.parametrize("v, trunc, even", [(2.5, 2, 2), (3.5, 3, 4), (-1.5, -1, -2), (-0.4, 0, 0)])
def test_bins(spark, v, trunc, even):
    assert one(spark, numbers.histogram_bin("x", "trunc"), x=v) == trunc
    assert one(spark, numbers.histogram_bin("x", "halfeven"), x=v) == even


def test_outcome(spark):
    rows = spark.createDataFrame([(5.0, 1), (5.0, 0), (4.9, 1), (4.9, 0)], "s double, t int")
    got = [r[0] for r in rows.select(numbers.outcome("s", "t", 5.0)).collect()]
    assert got == ["tp", "fp", "fn", "tn"]


def test_separation(spark):
    d = spark.createDataFrame([(359.9999, 0.0, 0.0001, 0.0), (10.0, 60.0, 10.0, 60.001), (0.0, 90.0, 123.0, 90.0)],
                              "a double, b double, c double, d double")
    got = [r[0] for r in d.select(sky.separation_arcsec(*[F.col(c) for c in "abcd"])).collect()]
    assert got == pytest.approx([0.72, 3.6, 0.0], abs=1e-6)
