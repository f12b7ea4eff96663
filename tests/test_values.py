"""Edge cases of names, filters, casts, text, arithmetic and constant replacement."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import colwright as cw


@pytest.fixture(scope="module")
def num(spark):
    rows = [
        (1, -2.0, "a b", "2024-02-29"),
        (2, 0.0, "x", None),
        (3, 5.0, None, "2023-03-04"),
        (4, None, "a,b,", "bad"),
    ]
    return spark.createDataFrame(rows, "i int, v double, t string, ds string").cache()


def column(df, name):
    """Values of a column in the order of `i`."""
    return [r[name] for r in df.orderBy("i").collect()]


def ids(df):
    return sorted(r.i for r in df.collect())


# Names


def test_new_name_is_normalised_and_guarded(spark):
    clash = spark.createDataFrame([(1, 2)], "a int, new_col int")
    with pytest.raises(ValueError, match="exists already"):
        cw.abs_new(clash, "a", "new col")
    with pytest.raises(ValueError, match="exists already"):
        cw.abs_new(clash, "a", "NEW COL")
    assert cw.abs_new(clash, "a", "other col").columns == ["a", "new_col", "other_col"]


def test_missing_columns_raise(num):
    for call in (
        lambda: cw.drop_column(num, "nope"),
        lambda: cw.rename_column(num, "nope", "x"),
        lambda: cw.upper(num, "nope"),
        lambda: cw.filter_equal(num, "nope", 1),
        lambda: cw.pick_first_n(num, "nope", "v", 1),
        lambda: cw.scale_minmax(num, "nope", "x"),
        lambda: cw.encode_category(num, "nope", "x"),
    ):
        with pytest.raises(ValueError, match="no such column"):
            call()


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([("ab", 1.5, "k")], "`a.b` string, `c d` double, `e``f` string")
    assert cw.upper(df, "a.b").first()[0] == "AB"
    assert cw.upper_new(df, "e`f", "g").first()["g"] == "K"
    assert cw.filter_greater(df, "c d", 1).count() == 1
    assert cw.scale_minmax(df, "c d", "s").first().s == 0.5
    assert cw.encode_category(df, "a.b", "code").first().code == 1
    assert cw.deduplicate(df, "a.b").count() == 1
    assert cw.column_profile(df).count() == 3
    assert cw.drop_columns(df, ["a.b"]).columns == ["c d", "e`f"]
    assert cw.rename_column(df, "a.b", "ab").columns == ["ab", "c d", "e`f"]


def test_insert_after(num):
    assert cw.abs_new(num, "v", "w", after="v").columns == ["i", "v", "w", "t", "ds"]
    assert cw.split_column(num, "t", ",", after_source=True).columns == [
        "i", "v", "t", "column_0", "column_1", "column_2", "ds",
    ]


# Structure


def test_rename(num):
    assert cw.rename_column(num, "v", "new name").columns == ["i", "new_name", "t", "ds"]
    assert cw.rename_column(num, "v", "V").columns == ["i", "V", "t", "ds"]
    with pytest.raises(ValueError, match="exists already"):
        cw.rename_column(num, "v", "t")


def test_to_integer(spark, num):
    assert column(cw.to_integer(num, "v"), "v") == [-2, 0, 5, None]
    texts = ["7", " 8 ", "-9", "+3", "12.7", "x", "", None, "99999999999", "\t4\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = column(df.withColumn("t", F.col("t").try_cast("int")), "t")
    assert column(cw.to_integer(df, "t"), "t") == plain == [7, 8, -9, 3, None, None, None, None, None, 4]
    assert cw.to_integer(num, "v").schema["v"].dataType.simpleString() == "int"
    numbers = [2147483647.9, -2147483648.9, 2147483648.0, -2147483649.0, float("nan"), float("inf"), -0.5, None]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, v double")
    want = [2147483647, -2147483648, None, None, None, None, 0, None]
    assert column(cw.to_integer(df, "v"), "v") == column(df.select("i", F.col("v").try_cast("int")), "v") == want
    whole = df.select("i", F.when(F.col("i") < 4, F.col("v")).cast("bigint").alias("v"))
    assert column(cw.to_integer(whole, "v"), "v")[:4] == [2147483647, -2147483648, None, None]


def test_concat_and_merge_are_null_if_any_is(num):
    assert column(cw.concat_columns(num, ["i", "t"], "x"), "x") == ["1a b", "2x", None, "4a,b,"]
    assert column(cw.merge_columns(num, ["i", "t", "v"], "x", "-"), "x") == ["1-a b--2.0", "2-x-0.0", None, None]


def test_split_keeps_trailing_pieces_and_fills_with_null(num):
    df = cw.split_column(num, "t", ",")
    assert df.columns == ["i", "v", "t", "ds", "column_0", "column_1", "column_2"]
    rows = [(r.column_0, r.column_1, r.column_2) for r in df.orderBy("i").collect()]
    assert rows == [("a b", None, None), ("x", None, None), (None, None, None), ("a", "b", "")]


def test_split_with_given_number(num):
    df = cw.split_column(num, "t", "[ ,]", n=4, prefix="p")
    assert [tuple(r[4:]) for r in df.orderBy("i").collect()] == [
        ("a", "b", None, None),
        ("x", None, None, None),
        (None,) * 4,
        ("a", "b", "", None),
    ]
    with pytest.raises(Exception, match="more than 2 pieces"):
        cw.split_column(num, "t", "[ ,]", n=2).collect()


def test_split_of_a_column_without_values(num):
    assert cw.split_column(num.where("t is null"), "t", ",").columns == num.columns


def test_split_twice_clashes_unless_prefixed(num):
    once = cw.split_column(num, "t", ",")
    with pytest.raises(ValueError, match="exists already"):
        cw.split_column(once, "t", " ")
    assert "second_0" in cw.split_column(once, "t", " ", prefix="second_").columns


# Filters


def test_filters(num):
    assert ids(cw.filter_equal(num, "v", "5")) == [3]
    assert ids(cw.filter_equal(num, "t", "x")) == [2]
    assert ids(cw.filter_equal(num, "i", [1, "4"])) == [1, 4]
    assert ids(cw.filter_not_equal(num, "v", 0)) == [1, 3]
    assert ids(cw.filter_greater(num, "v", "-2")) == [2, 3]
    assert ids(cw.filter_greater_equal(num, "v", -2)) == [1, 2, 3]
    assert ids(cw.filter_less(num, "v", 5)) == [1, 2]
    assert ids(cw.filter_less_equal(num, "v", 5)) == [1, 2, 3]
    assert ids(cw.filter_between(num, "v", 0, 5)) == [2, 3]
    assert ids(cw.filter_null(num, "v")) == [4]
    assert ids(cw.filter_not_null(num, "v")) == [1, 2, 3]
    assert ids(cw.delete_negative(num, "v")) == [2, 3]
    assert ids(cw.delete_zero(num, "v")) == [1, 3]
    assert ids(cw.delete_null(num, "t")) == [1, 2, 4]
    assert ids(cw.filter_startswith(num, "t", "a")) == [1, 4]
    assert ids(cw.filter_endswith(num, "t", ",")) == [4]


def test_contains_has_wildcards_unless_literal(spark):
    df = spark.createDataFrame([(1, "50%"), (2, "50 of"), (3, "a_b"), (4, "A_B")], "i int, t string")
    assert ids(cw.filter_contains(df, "t", "5_%")) == [1, 2]
    assert ids(cw.filter_contains(df, "t", "a_b")) == [3]
    assert ids(cw.filter_contains(df, "t", "%", literal=True)) == [1]


def test_filter_and_complement_and_nulls_make_the_table(num):
    total = num.count()
    for keep, rest in (
        (cw.filter_greater, cw.filter_less_equal),
        (cw.filter_less, cw.filter_greater_equal),
        (cw.filter_equal, cw.filter_not_equal),
    ):
        assert keep(num, "v", 0).count() + rest(num, "v", 0).count() + cw.filter_null(num, "v").count() == total


def test_filter_literals_take_the_type_of_the_column(spark):
    df = spark.sql(
        "SELECT i, cast(i AS float) / 10 AS f, cast(i AS decimal(6,2)) AS d, cast(i AS bigint) AS b, i % 2 = 0 AS odd,"
        " date_add(date'2024-01-01', i) AS day, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,i) AS ts"
        " FROM (SELECT explode(sequence(1, 5)) AS i)"
    )
    assert ids(cw.filter_equal(df, "f", 0.3)) == [3]
    assert ids(cw.filter_greater(df, "d", "3.5")) == [4, 5]
    assert ids(cw.filter_greater(df, "i", "3.5")) == [4, 5]
    assert ids(cw.filter_less(df, "i", 2**40)) == [1, 2, 3, 4, 5]
    assert ids(cw.filter_less(df, "b", 2**70)) == [1, 2, 3, 4, 5]
    assert ids(cw.filter_equal(df, "odd", "true")) == [2, 4]
    assert ids(cw.filter_between(df, "day", "2024-01-03", date(2024, 1, 4))) == [2, 3]
    assert ids(cw.filter_greater(df, "day", "2024-01-03 12:00:00")) == [3, 4, 5]
    assert ids(cw.filter_less(df, "ts", datetime(2024, 1, 3))) == [1]
    with pytest.raises(ValueError, match="is not a number"):
        cw.filter_equal(df, "i", "abc")
    with pytest.raises(ValueError, match="ISO date"):
        cw.filter_equal(df, "day", "soon")


# Replacement


def test_replacement_by_constants_leaves_other_rows(num):
    assert column(cw.replace_null_const(num, "v", "9"), "v") == [-2.0, 0.0, 5.0, 9.0]
    assert column(cw.replace_null_const(num, "t", "none"), "t") == ["a b", "x", "none", "a,b,"]
    assert column(cw.replace_negative_const(num, "v", 1), "v") == [1.0, 0.0, 5.0, None]
    assert column(cw.replace_zero_const(num, "v", 1), "v") == [-2.0, 1.0, 5.0, None]
    assert cw.replace_null_const(num, "i", 3).schema["i"].dataType.simpleString() == "int"
    with pytest.raises(ValueError, match="does not fit"):
        cw.replace_null_const(num, "i", "2.5")
    with pytest.raises(ValueError, match="does not fit"):
        cw.replace_null_const(num, "i", 2**31)
    with pytest.raises(ValueError, match="not numeric"):
        cw.replace_negative_const(num, "t", 1)


def test_replacement_by_mean_and_median(num):
    assert column(cw.replace_null_mean(num, "v"), "v") == [-2.0, 0.0, 5.0, 1.0]
    assert column(cw.replace_null_median(num, "v"), "v") == [-2.0, 0.0, 5.0, 0.0]
    assert column(cw.replace_negative_mean(num, "v"), "v") == [1.0, 0.0, 5.0, None]
    assert column(cw.replace_negative_median(num, "v"), "v") == [0.0, 0.0, 5.0, None]
    assert column(cw.replace_zero_mean(num, "v"), "v") == [-2.0, 1.0, 5.0, None]
    assert column(cw.replace_zero_median(num, "v"), "v") == [-2.0, 0.0, 5.0, None]
    assert column(cw.replace_null_median(num, "v", approx=True), "v") == [-2.0, 0.0, 5.0, 0.0]
    assert column(cw.replace_zero_mean(cw.to_integer(num, "v"), "v"), "v") == [-2.0, 1.0, 5.0, None]


def test_replacement_keeps_big_integers_and_decimals(spark):
    from decimal import Decimal

    big = 9007199254740993
    rows = [(1, big, "0.10"), (2, None, None), (3, big + 1, "9.99"), (4, 0, "0.00"), (5, -5, "-1.01")]
    df = spark.createDataFrame(rows, "i int, b long, s string")
    df = df.select("i", "b", df.s.cast("decimal(12,2)").alias("d"))
    for filled in (cw.replace_null_mean(df, "b"), cw.replace_null_median(df, "b")):
        assert filled.schema["b"].dataType.simpleString() == "decimal(25,6)"
        rows = column(filled, "b")
        assert (rows[0], rows[2:]) == (big, [big + 1, 0, -5])
    assert column(cw.replace_null_mean(df, "b"), "b")[1] == Decimal("4503599627370495.5")
    assert column(cw.replace_null_median(df, "b"), "b")[1] == Decimal("4503599627370496.5")
    assert column(cw.replace_zero_median(df, "b"), "b")[3] == Decimal("4503599627370496.5")
    assert cw.replace_null_median(df, "d").schema["d"].dataType.simpleString() == "decimal(12,2)"
    assert column(cw.replace_null_mean(df, "d"), "d")[1] == Decimal("2.27")
    assert column(cw.replace_negative_median(df, "d"), "d") == [Decimal(x) if x else None for x in ("0.10", None, "9.99", "0.00", "0.05")]
    steps = [cw.Step("replace_null_median", "b"), cw.Step("replace_null_mean", "d"), cw.Step("bin_quantile", "b", {"new_column": "q"})]
    fitted = cw.steps_of(cw.steps_table(spark, cw.fit_recipe(df, steps)))
    assert [tuple(r) for r in cw.apply_recipe(df, fitted).collect()] == [tuple(r) for r in cw.apply_recipe(df, steps).collect()]


def test_replacement_without_any_value(num):
    empty = num.where("v is null")
    assert column(cw.replace_null_mean(empty, "v"), "v") == [None]
    assert column(cw.replace_null_median(empty, "v"), "v") == [None]


def test_replace_value(num):
    assert column(cw.replace_value(num, "v", 5, 6, "w"), "w") == [-2.0, 0.0, 6.0, None]
    assert column(cw.replace_value(num, "v", "null", 6, "w"), "w") == [-2.0, 0.0, 5.0, 6.0]
    assert column(cw.replace_value(num, "t", "x", "y", "w"), "w") == ["a b", "y", None, "a,b,"]
    assert cw.replace_value(num, "i", 1, 2, "w").schema["w"].dataType.simpleString() == "int"


# Text


def test_text(spark):
    df = spark.createDataFrame([(1, "  hELLO wORLD "), (2, None)], "i int, t string")
    assert column(cw.trim(df, "t"), "t") == ["hELLO wORLD", None]
    assert column(cw.initcap(df, "t"), "t") == ["  Hello World ", None]
    assert column(cw.initcap(df, "t", "u"), "u") == ["  Hello World ", None]
    assert column(cw.upper(df, "t"), "t") == ["  HELLO WORLD ", None]
    assert column(cw.lower_new(df, "t", "u"), "u") == ["  hello world ", None]
    assert column(cw.substring_new(df, "t", 3, 5, "u"), "u") == ["hELLO", None]
    assert column(cw.replace_text(df, "t", "[LO]+", "l"), "t") == ["  hEl wlRlD ", None]
    assert column(cw.replace_text_new(df, "t", "(h)(E)", "$2$1", "u"), "u") == ["  EhLLO wORLD ", None]


# Arithmetic


def test_arithmetic(num):
    assert column(cw.sum_columns(num, ["i", "v", "i"], "x"), "x") == [0.0, 4.0, 11.0, None]
    assert column(cw.sub_columns(num, ["i", "v", "i"], "x"), "x") == [2.0, 0.0, -5.0, None]
    assert column(cw.mul_columns(num, ["i", "v"], "x"), "x") == [-2.0, 0.0, 15.0, None]
    assert column(cw.div_columns(num, ["i", "v"], "x"), "x") == [-0.5, None, 0.6, None]
    assert column(cw.sum_columns(num, "i", "x"), "x") == [1, 2, 3, 4]


def test_integer_overflow_is_null(spark):
    df = spark.createDataFrame([(1, 2**31 - 1)], "i int, j int")
    assert cw.sum_columns(df, ["i", "j"], "x").first().x is None


def test_maths(num):
    assert column(cw.log_new(num, "v", "x"), "x") == [None, None, 1.6094, None]
    assert column(cw.scale_log(num, "v", "x"), "x") == [None, None, 1.6094, None]
    roots = column(cw.sqrt_new(num, "v", "x"), "x")
    assert math.isnan(roots[0]) and roots[1:] == [0.0, 2.2361, None]
    assert column(cw.square_new(num, "v", "x"), "x") == [4.0, 0.0, 25.0, None]
    assert column(cw.abs_new(num, "v", "x"), "x") == [2.0, 0.0, 5.0, None]
    halves = num.withColumn("v", F.col("v") / 4)
    assert column(cw.ceil_new(halves, "v", "x"), "x") == [0, 0, 2, None]
    assert column(cw.floor_new(halves, "v", "x"), "x") == [-1, 0, 1, None]
    assert column(cw.round_column(halves, "v", 1), "v") == [-0.5, 0.0, 1.3, None]


# Dates


def test_dates(spark):
    days = [date(2024, 2, 29), date(2024, 3, 2), date(2024, 3, 3), None]
    df = spark.createDataFrame(list(enumerate(days)), "i int, d date")
    assert column(cw.extract_day_of_week(df, "d", "x"), "x") == [5, 7, 1, None]
    assert column(cw.is_weekday(df, "d", "x"), "x") == [True, False, False, False]
    assert column(cw.extract_year(df, "d", "x"), "x") == [2024, 2024, 2024, None]
    assert column(cw.extract_month(df, "d", "x"), "x") == [2, 3, 3, None]
    assert column(cw.extract_day(df, "d", "x"), "x") == [29, 2, 3, None]


def test_text_dates(num):
    assert column(cw.extract_year(num, "ds", "x"), "x") == [2024, None, 2023, None]
    assert column(cw.change_date_format(num, "ds", "dd/MM/yyyy"), "ds") == ["29/02/2024", None, "04/03/2023", None]
    assert column(cw.change_date_format(num, "ds", "%d.%m.%y", read_as="%Y-%m-%d"), "ds") == [
        "29.02.24", None, "04.03.23", None,
    ]
    assert column(cw.parse_date(num, "ds", "yyyy-MM-dd"), "ds") == [date(2024, 2, 29), None, date(2023, 3, 4), None]


def test_date_difference_counts_calendar_days(spark):
    row = (datetime(2024, 3, 1, 0, 0, 1), datetime(2024, 2, 28, 23, 59, 59))
    df = spark.createDataFrame([row], "a timestamp_ntz, b timestamp_ntz")
    assert cw.date_diff(df, "a", "b", "x").first().x == 2
    assert cw.extract_second(df, "b", "x").first().x == 59
    assert cw.extract_hour(df, "b", "x").first().x == 23
    assert cw.extract_minute(df, "b", "x").first().x == 59


def test_leap_years(spark):
    df = spark.createDataFrame([(1900,), (2000,), (2023,), (2024,), (None,)], "i int")
    assert {r.i: r.leap for r in cw.is_leap_year(df, "i", "leap").collect()} == {
        1900: False, 2000: True, 2023: False, 2024: True, None: None,
    }


def test_strftime_patterns(spark):
    from colwright.functions.calendar import datetime_pattern

    assert datetime_pattern("yyyy-MM-dd") == "yyyy-MM-dd"
    assert datetime_pattern("%d/%m/%Y") == "dd/MM/yyyy"
    assert datetime_pattern("%Y at %H o'clock 100%%") == "yyyy' at 'HH' o''clock 100%'"
    with pytest.raises(ValueError, match="no counterpart"):
        datetime_pattern("%Q")
    df = spark.sql("SELECT timestamp_ntz'2024-02-09 15:04:05' AS ts")
    for pattern in ("%Y at %H o'clock 100%%", "%A %d %B %Y", "%a %b %j", "%I:%M:%S %p", "%F %T"):
        want = datetime(2024, 2, 9, 15, 4, 5).strftime(pattern)
        assert cw.change_date_format(df, "ts", pattern).first().ts == want
