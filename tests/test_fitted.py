"""Scaling, binning, encoding, profiling and exact quantiles."""

import math
import random
from decimal import Context, Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import Bucketizer, MinMaxScaler, QuantileDiscretizer, StandardScaler, VectorAssembler
from pyspark.sql import functions as F

import colwright as cw
from colwright.operators import encode
from colwright.plans import quantiles
from colwright.plans.quantiles import Quantiles, exact_quantiles
from colwright.sources import shared


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def seq(spark):
    return spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double").coalesce(1)


@pytest.fixture(scope="module")
def const(spark):
    return spark.createDataFrame([(3.0,), (3.0,)], "v double")


def test_scales(seq):
    assert column(cw.scale_standard(seq, "v", "s"), "s")[:3] == [0.4082, 0.8165, 1.2247]
    assert column(cw.scale_minmax(seq, "v", "s"), "s")[:3] == [0.0, 0.1429, 0.2857]
    assert column(cw.scale_robust(seq, "v", "s"), "s")[:2] == [-1.0, -0.7143]
    assert column(cw.bin_quantile(seq, "v", "b"), "b") == [0, 1, 1, 2, 2, 3, 3, 3]
    assert column(cw.bin_quantile(seq, "v", "b", approx=True), "b") == [0, 1, 1, 2, 2, 3, 3, 3]


def test_scales_of_a_constant(spark, const):
    assert column(cw.scale_standard(const, "v", "s"), "s") == [0.0, 0.0]
    assert column(cw.scale_minmax(const, "v", "s"), "s") == [0.5, 0.5]
    assert column(cw.scale_robust(const, "v", "s"), "s") == [0.0, 0.0]
    assert column(cw.scale_robust(const, "v", "s", approx=True), "s") == [0.0, 0.0]
    one = const.limit(1)
    assert column(cw.scale_standard(one, "v", "s"), "s") == [0.0]


def test_scales_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert cw.scale_standard(df, "v", "s").count() == 2
    assert cw.scale_minmax(df, "v", "s").count() == 2
    assert sorted(column(cw.scale_robust(df, "v", "s"), "s")) == [-0.6667, 0.0, 1.3333]  # null counts as 0
    assert column(cw.scale_robust(df.where("v is null"), "v", "s"), "s") == [0.0]


def test_nan_counts_as_missing_in_every_fit(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, float("nan")), (4, None), (5, 5.0)], "i int, x double")
    by_id = lambda t, c: {r.i: r[c] for r in t.collect()}
    assert by_id(cw.scale_minmax(df, "x", "s"), "s") == {1: 0.0, 2: 0.5, 5: 1.0}
    assert by_id(cw.scale_standard(df, "x", "s"), "s") == {1: 0.5, 2: 1.5, 5: 2.5}
    for filled in (cw.replace_null_mean(df, "x"), cw.replace_null_median(df, "x")):
        found = by_id(filled, "x")
        assert found[4] == 3.0 and math.isnan(found[3])


def test_scaled_values_lie_between_0_and_1(spark):
    random.seed(5)
    df = spark.createDataFrame([(random.gauss(0, 100),) for _ in range(500)], "v double")
    scaled = column(cw.scale_minmax(df, "v", "s"), "s")
    assert min(scaled) == 0 and max(scaled) == 1


def test_scales_agree_with_spark_ml(spark):
    random.seed(6)
    df = spark.createDataFrame([(random.uniform(-50, 1000),) for _ in range(400)], "v double").coalesce(1)
    vectors = VectorAssembler(inputCols=["v"], outputCol="x").transform(df)
    for scaler, ours in ((StandardScaler, cw.scale_standard), (MinMaxScaler, cw.scale_minmax)):
        model = scaler(inputCol="x", outputCol="y").fit(vectors)
        theirs = [round(float(r.y[0]), 4) for r in model.transform(vectors).collect()]
        assert column(ours(df, "v", "s"), "s") == pytest.approx(theirs, abs=1e-4)


def test_bins_agree_with_spark_ml(spark):
    random.seed(7)
    df = spark.createDataFrame([(float(random.randint(0, 50)),) for _ in range(400)], "v double").coalesce(1)
    edges, labels = [0.0, 10.0, 25.0, 50.0], ["a", "b", "c"]
    theirs = Bucketizer(splits=edges, inputCol="v", outputCol="b").transform(df)
    ours = cw.bin_labels(df, "v", edges[:-1], [9, 24, 50], labels, "b")
    assert column(ours, "b") == [labels[int(b)] for b in column(theirs, "b")]
    discretizer = QuantileDiscretizer(numBuckets=4, inputCol="v", outputCol="b", relativeError=0.0)
    assert column(cw.bin_quantile(df, "v", "b"), "b") == column(discretizer.fit(df).transform(df), "b")


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (None,)], "v double").coalesce(1)
    call = lambda d, **o: cw.bin_labels(d, "v", [0, 10], [9, 20], ["low", "high"], "b", **o)
    assert column(call(df), "b") == ["low", "high", "high", None]
    outside = spark.createDataFrame([(20.1,), (-0.1,), (5.0,)], "v double").coalesce(1)
    with pytest.raises(Exception, match="outside the bins"):
        call(outside).collect()
    assert column(call(outside, on_outside="null"), "b") == [None, None, "low"]
    with pytest.raises(ValueError, match="increase strictly"):
        cw.bin_labels(df, "v", [10, 0], [20], ["a", "b"], "b")
    with pytest.raises(ValueError, match="as many labels"):
        cw.bin_labels(df, "v", [0, 10], [9, 20], ["a"], "b")


def test_duplicate_cuts_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 7 + [(2.0,), (None,)], "v double").coalesce(1)
    assert column(cw.bin_quantile(df, "v", "b"), "b") == [1.0] * 7 + [1.0, None]


# Encoding


def codes(df, **options):
    return {r.c: r.code for r in cw.encode_category(df, "c", "code", **options).collect()}


def test_codes(spark):
    make = lambda *values: spark.createDataFrame([(v,) for v in values], "c string")
    assert codes(make("b", "a", "b")) == {"a": 0, "b": 1}
    assert codes(make("a", None)) == {"a": 0, None: None}
    assert codes(make("c", "a", None, "b")) == {"a": 1, "b": 2, "c": 3, None: None}
    assert codes(make(None, None)) == {None: None}
    assert codes(make("z", "é", "Z", "")) == {"": 1, "Z": 2, "z": 3, "é": 4}
    many = [f"v{i % 700:04d}" for i in range(3000)] + ["hot"] * 3000 + [None] * 500
    expected = {v: i + 1 for i, v in enumerate(sorted({v for v in many if v}))} | {None: None}
    df = make(*many)
    assert codes(df) == expected
    assert cw.encode_category(df, "c", "code").count() == len(many)


def test_codes_of_other_types(spark):
    df = spark.createDataFrame([(float("nan"),), (10.0,), (9.0,), (None,)], "c double")
    result = cw.encode_category(df, "c", "code").collect()
    assert sorted((r.code is None, r.code or 0) for r in result) == [(False, 1), (False, 2), (True, 0), (True, 0)]
    stamps = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0,0,0,i) AS c FROM (SELECT explode(sequence(1,3)) i)")
    assert sorted(r.code for r in cw.encode_category(stamps, "c", "code").collect()) == [1, 2, 3]
    whole = spark.createDataFrame([(10,), (9,), (100,)], "c bigint")
    assert codes(whole) == {9: 1, 10: 2, 100: 3}


def test_long_texts_are_not_collected(spark):
    df = spark.createDataFrame([("x" * 5000,), ("y",)], "c string")
    assert encode.Categories("c").run(df).keys() == {"first", "table"}
    assert codes(df) == {"x" * 5000: 0, "y": 1}


# Profile


def test_profile(spark):
    rows = [(i, i % 10, float(i % 11), str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "a bigint, b int, c double, d string")
    want = [
        ("a", "continuous", "integer", 0),
        ("b", "classification", "integer", 1),
        ("c", "continuous", "integer", 2),
        ("d", "continuous", "string", 3),
    ]
    assert [tuple(r) for r in cw.column_profile(df).collect()] == want
    assert [tuple(r) for r in cw.column_profile(df, approx=True).collect()] == want


def test_profile_counts_every_type(spark):
    from colwright.operators.profile import _about_distinct, _distinct

    df = spark.sql(
        "SELECT i, cast(nullif(i % 4, 0) AS float) / 10 AS f, cast(i % 5 AS decimal(5,2)) AS d, i % 2 = 0 AS odd,"
        " timestamp'2024-11-03 00:00:00' + make_interval(0,0,0,0,0,i*30) AS ts, array('a, b', if(i > 9, 'a', null)) AS a,"
        " named_struct('x', i % 3) AS s, map('k', i % 6) AS m, encode(concat(i % 7, ''), 'utf-8') AS bin,"
        " concat(repeat('long ', 100), i % 8) AS t, cast(null AS string) AS nothing,"
        " if(i = 1, double('nan'), if(i % 2 = 0, 0D, -0D)) AS z FROM (SELECT explode(sequence(1, 40)) AS i)"
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        want = (40, 40, 3, 5, 2, 40, 2, 3, 6, 7, 8, 0, 2)
        assert tuple(_distinct(df).first()) == want
        assert tuple(_about_distinct(df.drop("z")).first()) == want[:-1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    empty = df.where("i < 0").select("i", "t")
    assert [r.ftype for r in cw.column_profile(empty).collect()] == ["classification"] * 2
    assert [r.ftype for r in cw.column_profile(empty, approx=True).collect()] == ["classification"] * 2


def test_whole_numbers_stay_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big,), (big + 2,)], "v bigint")
    assert tuple(cw.column_min_max(df, "v").first()) == (big, big + 2)
    with pytest.raises(ValueError, match="'d'"):
        cw.column_min_max(spark.sql("SELECT current_date() AS d"), "d")
    money = spark.sql("SELECT cast(null AS decimal(10,2)) AS m")
    assert str(cw.replace_null_const(money, "m", "9.99").first().m) == "9.99"
    with pytest.raises(ValueError, match="does not fit"):
        cw.replace_null_const(money, "m", "9.999")


def test_ceil_floor_and_abs_out_of_range(spark):
    df = spark.createDataFrame([(float("nan"), -(2**31), "x"), (1e300, 5, "4")], "d double, i int, t string")
    assert column(cw.ceil_new(df, "d", "n"), "n") == column(cw.floor_new(df, "d", "n"), "n") == [None, None]
    assert column(cw.abs_new(df, "i", "n"), "n") == [None, 5]
    assert column(cw.sqrt_new(df, "t", "n"), "n") == [None, 2.0] and column(cw.is_leap_year(df, "t", "n"), "n") == [None, True]


def test_backslashes_are_ordinary(spark):
    df = spark.createDataFrame([("a\\b",), ("x\\",), ("axb",)], "t string")
    assert column(cw.filter_contains(df, "t", "a\\b"), "t") == ["a\\b"]
    assert column(cw.filter_contains(df, "t", "x\\"), "t") == ["x\\"]
    assert column(cw.filter_contains(df, "t", "a_b"), "t") == ["a\\b", "axb"]


def test_min_max_mean_describe(spark):
    df = spark.createDataFrame([(-1.9, "3.7"), (2.9, "-4.2"), (None, None)], "v double, t string")
    assert tuple(cw.column_min_max(df, "v").first()) == (-1, 2)
    assert cw.column_mean(df, "v").first().mean == pytest.approx(0.5)
    assert cw.column_mean(df, "t").first().mean == pytest.approx(-0.25)
    row = cw.column_describe(df, ["v"]).first()
    assert (row.column_name, row["count"], row.min, row.max) == ("v", 2, -1.9, 2.9)
    assert row.stddev == pytest.approx(np.std([-1.9, 2.9], ddof=1))


def test_counts_and_metadata(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, None)], "i int, t string")
    assert cw.distinct_count(df, "i").first().distinct_count == 2
    assert cw.distinct_values(df, "t").count() == 2
    assert cw.row_count(df).first().rows == 3
    assert cw.column_count(df) == 2
    assert tuple(cw.table_size(df).first()) == (3, 2)
    wide = spark.sql("SELECT 1L AS a, date'2024-01-01' AS b, array(1) AS c, 1.5BD AS d, 'x' AS e")
    assert [tuple(r) for r in cw.column_metadata(wide).collect()] == [
        (0, "a", "integer"), (1, "b", "date"), (2, "c", "array<int>"), (3, "d", "integer"), (4, "e", "string"),
    ]


# Exact quantiles


def check_quantiles(spark, values, fractions=(0.0, 0.1, 0.25, 0.5, 0.75, 1.0)):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    smooth, stepped = exact_quantiles(
        df, [Quantiles(F.col("v"), fractions, True), Quantiles(F.col("v"), fractions, False)]
    )
    clean = sorted(v for v in values if v is not None and not math.isnan(v))
    if not clean:
        assert smooth == stepped == [None] * len(fractions)
        return
    assert stepped == [clean[max(1, math.ceil(f * len(clean))) - 1] for f in fractions]
    if all(math.isfinite(v) and abs(v) < 1e300 for v in clean):
        assert smooth == pytest.approx(list(np.quantile(clean, fractions)), rel=1e-9, abs=1e-12)


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    random.seed(8)
    check_quantiles(spark, [])
    check_quantiles(spark, [None, float("nan")])
    check_quantiles(spark, [3.0])
    check_quantiles(spark, [3.0] * 50 + [1.0])
    check_quantiles(spark, [random.gauss(0, 1) for _ in range(999)])
    check_quantiles(spark, [random.lognormvariate(0, 5) for _ in range(500)] + [None] * 20 + [1e300])
    check_quantiles(spark, [-math.inf, math.inf, 0.0, -0.0, 1e308, -1e308, 5e-324, 1.0, 2.0])


def test_quantiles_of_big_integers_and_decimals(spark):
    random.seed(9)
    ints = [2**62 + random.randrange(900) for _ in range(300)] + [-(2**63), 2**63 - 1, 0, 7]
    decs = [Decimal(random.randrange(-(10**37), 10**37)).scaleb(-10, Context(prec=60)) for _ in ints]
    df = spark.createDataFrame(list(zip(ints, decs, map(float, ints))), "i long, d decimal(38,10), f double")
    at = (0.0, 0.25, 0.5, 1.0)
    found = exact_quantiles(df, [Quantiles(F.col(c), at, False) for c in "idf"])
    for got, values in zip(found, (ints, decs, list(map(float, ints)))):
        values = sorted(values)
        assert got == [values[max(1, math.ceil(f * len(values))) - 1] for f in at]
    middle = sorted(ints)[len(ints) // 2 - 1 : len(ints) // 2 + 1]
    assert exact_quantiles(df, [Quantiles(F.col("i"), [0.5], True)]) == [[Decimal(sum(middle)) / 2]]


def test_quantiles_read_their_input_once_and_leave_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    df = spark.range(1000).select(seen.asNondeterministic()(F.col("id").cast("double")).alias("v"))
    assert exact_quantiles(df, [Quantiles(F.col("v"), [0.5], True)]) == [[499.5]]
    assert read.value == 1000
    assert not list(tmp_path.iterdir())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_quantiles_of_anything(spark, values):
    before = quantiles.BUCKETS
    quantiles.BUCKETS = 64
    try:
        check_quantiles(spark, values, (0.25, 0.5))
    finally:
        quantiles.BUCKETS = before
