import math

from yakinma.operators.hotkeys import distinct_per_key, heavy_keys, key_figures

SCHEMA = "company string, resolved int, hours double, n bigint, title string"


def rows():
    hot = [("a", i % 2, float(i % 7), 1, f"t{i % 3}") for i in range(60)]
    return hot + [("b", None, float("nan"), 1, None), ("b", 1, -3.0, 1, "x"), (None, 1, 2.0, 1, "x"), ("c", 0, None, 1, "x"), ("c", 0, float("inf"), 1, "x")]


def test_heavy_and_figures(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert [r.company for r in heavy_keys(df, "company").collect()] == ["a"]
    got = {r.company: r for r in key_figures(df, "company", ["resolved"], ["hours"]).collect()}
    assert got["a"].n_rows == 60 and got["a"].n_resolved == 30
    assert math.isclose(got["a"].hours_sum, sum(i % 7 for i in range(60)))
    assert got["b"].hours_n == 0 and got["b"].hours_sum is None and got["b"].n_resolved == 1
    assert got["c"].hours_n == 0 and got[None].n_rows == 1


def test_exactly_one_twentieth_is_not_heavy(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1, "t")] + [(f"k{i}", 1, 1.0, 1, "t") for i in range(19)], SCHEMA)
    assert heavy_keys(df, "company").count() == 0


def test_distinct_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r.company: r.n_distinct for r in distinct_per_key(df, "company", "title").collect()}["a"] == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(empty, "company").count() == 0 and key_figures(empty, "company", ["resolved"], ["hours"]).count() == 0


def test_measures_of_any_magnitude(spark):
    df = spark.createDataFrame([("a", 1, x, 1, "t") for x in (3e10, 1e17, 0.00001)] + [("b", 1, 3e10, 1, "t")], SCHEMA)
    got = {r.company: r for r in key_figures(df, "company", [], ["hours"]).collect()}
    assert (got["a"].hours_n, got["a"].hours_max, got["a"].hours_min) == (3, 1e17, 0.00001) and math.isclose(got["a"].hours_sum, 1e17 + 3e10)
    assert got["b"].hours_sum == 3e10 and got["b"].hours_sd is None
