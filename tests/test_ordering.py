"""Sorting, rows per group, de-duplication and joins."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import colwright as cw


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_sorts(spark):
    values = [3, None, 1, 2, None, 3, 1]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").coalesce(1)
    assert [r.v for r in cw.sort_asc(df, "v").collect()] == [None, None, 1, 1, 2, 3, 3]
    assert [r.v for r in cw.sort_desc(df, "v").collect()] == [3, 3, 2, 1, 1, None, None]
    assert cw.sort_asc(df, "v").collect() == cw.sort_asc(df.repartition(3), "v").collect()
    assert cw.sort_asc(df, "v").columns == ["i", "v"]


def test_a_hot_value_does_not_sort_into_one_task(spark):
    df = spark.range(0, 100_000, numPartitions=8).select(F.lit(7).alias("v"), "id")
    sizes = cw.sort_asc(df, "v").groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sizes.agg(F.max("count")).first()[0] < 50_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("sort", [cw.sort_asc, cw.sort_desc])
def test_copies_of_one_row_are_dealt_over_tasks(spark, sort):
    n = 200_000
    half = spark.range(0, n, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).alias("v"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = sort(half, "v", split_copies=True, part_rows=1000)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) <= 2 * n / 8
    found = [tuple(r) for r in made.collect()]
    assert [r[0] for r in found] == sorted((r[0] for r in found), reverse=sort is cw.sort_desc)
    assert Counter(found) == rows(half)


def test_sorted_copies_come_out_as_they_went_in(spark):
    values = [(None, "a", None, -0.0), ("a", None, [1.5], 0.0), (None, None, [-0.0], float("nan")), (None, None, [0.0], None)]
    df = spark.createDataFrame(values * 300, "a string, b string, c array<double>, tie float").repartition(5)
    made = cw.sort_asc(df, "a", split_copies=True, part_rows=100)
    assert made.columns == df.columns
    assert Counter(map(repr, made.collect())) == Counter(map(repr, df.collect()))
    assert [r.a for r in made.collect()] == [None] * 900 + ["a"] * 300
    few = cw.sort_asc(df, "a", split_copies=True, part_rows=1000)
    assert Counter(map(repr, few.collect())) == Counter(map(repr, df.collect()))
    assert cw.sort_asc(df.limit(0), "a", split_copies=True).collect() == []
    mapped = df.limit(5).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert cw.sort_asc(mapped, "a", split_copies=True, part_rows=1).count() == 5


def test_filters_reach_the_scan_of_a_sort_with_copies(spark, tmp_path):
    path = str(tmp_path / "copies")
    spark.range(3000).select((F.col("id") % 2).alias("v"), F.lit("x").alias("t")).write.parquet(path)
    made = cw.filter_equal(cw.sort_asc(cw.read_parquet(spark, path), "v", split_copies=True, part_rows=1000), "v", 1)
    assert made.count() == 1500
    assert "EqualTo(v,1)" in made._jdf.queryExecution().toString()


def test_sort_by_date(spark):
    texts = ["03/02/2024", "bad", "29/12/2023", None, "01/03/2024"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string").coalesce(1)
    result = cw.sort_by_date(df, "d", "%Y-%m-%d", read_as="dd/MM/yyyy")
    assert [tuple(r) for r in result.collect()] == [
        (2, "2023-12-29"), (0, "2024-02-03"), (4, "2024-03-01"), (1, None), (3, None),
    ]


def test_pick_keeps_ties(spark):
    data = [("p", 5), ("p", 5), ("p", 4), ("p", 3), ("q", 1), (None, 2), (None, None)]
    ties = spark.createDataFrame(data, "g string, x int")
    first = cw.pick_first_n(ties, "g", "x", "2")
    assert first.columns == ["g", "x", "rank"]
    assert rows(first) == Counter({("p", 5, 1): 2, ("q", 1, 1): 1, (None, 2, 1): 1, (None, None, 2): 1})
    last = cw.pick_last_n(ties, "g", "x", 1)
    assert rows(last) == Counter({("p", 3, 1): 1, ("q", 1, 1): 1, (None, None, 1): 1})


def test_picking_agrees_with_ranking_rows(spark):
    random.seed(3)
    data = [(random.choice("aaab"), random.choice([None, *range(3000)])) for _ in range(9000)]
    df = spark.createDataFrame(data, "g string, x int")
    for pick in (cw.pick_first_n, cw.pick_last_n):
        for n in (3, 90):
            order = F.col("x").desc() if pick is cw.pick_first_n else F.col("x").asc()
            ranked = df.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(order))).where(F.col("rank") <= n)
            assert rows(pick(df, "g", "x", n)) == rows(ranked)
    assert rows(cw.pick_first_n(df, "g", "x", 1000)) == rows(cw.pick_first_n(df, "g", "x", 1500).where("rank <= 1000"))
    assert rows(cw.pick_first_n(df, "g", "x", 10_000).drop("rank")) == rows(df)


def test_pick_refuses_a_taken_rank_column(spark):
    df = spark.createDataFrame([(1, 2)], "g int, rank int")
    with pytest.raises(ValueError, match="exists already"):
        cw.pick_first_n(df, "g", "rank", 1)


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "d"), (2, "e")], "k int, t string")
    assert rows(cw.deduplicate(df, "k", order_by="t")) == Counter([(1, "a"), (None, "c"), (2, "e")])
    assert rows(cw.deduplicate(df, "k").select("k")) == Counter([(1,), (None,), (2,)])


EXPECTED = {
    "inner": [(2, "b", "x"), (2, "c", "x")],
    "left": [(1, "a", None), (2, "b", "x"), (2, "c", "x"), (None, "d", None)],
    "right": [(2, "b", "x"), (2, "c", "x"), (3, None, "y"), (None, None, "z")],
    "full": [
        (1, "a", None), (2, "b", "x"), (2, "c", "x"), (None, "d", None), (3, None, "y"), (None, None, "z"),
    ],
    "left_semi": [(2, "b"), (2, "c")],
    "left_anti": [(1, "a"), (None, "d")],
}


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("how", sorted(EXPECTED))
def test_joins(spark, how, split):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "rk int, r string")
    result = cw.join_tables(left, right, "k", "rk", how, split_hot_keys=split)
    assert result.columns == (["k", "l"] if how in ("left_semi", "left_anti") else ["k", "l", "r"])
    assert rows(result) == Counter(EXPECTED[how])


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("how", sorted(EXPECTED))
def test_splitting_hot_keys_changes_no_result(spark, how, swap):
    # A third of the left rows share a key, a third have none; one right key is hot as well.
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("l")
    )
    right = spark.range(60).select(
        F.when(F.col("id") % 4 == 0, 7).when(F.col("id") % 4 == 1, F.col("id") * 50).alias("k"), F.col("id").alias("r")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, other = (right, left) if swap else (left, right)
        split = cw.join_tables(one, other, "k", how=how, part_rows=50)
        plain = cw.join_tables(one, other, "k", how=how, split_hot_keys=False)
        assert split.columns == plain.columns
        assert rows(split) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_key_hot_on_both_sides_is_dealt_on_a_grid(spark):
    left = spark.range(4000).selectExpr("if(id % 400 = 0, 1, id + 10) AS k", "id AS l")
    right = spark.range(4000).selectExpr("if(id % 2 = 0, 1, -id) AS k", "id AS r", "id AS __at")
    joined = cw.join_tables(left, right, "k")
    assert joined.count() == 10 * 2000 and joined.columns == ["k", "l", "r", "__at"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in cw.join_tables(left, right, "k", part_rows=10).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 2 * 10 * 2000 / 8


@pytest.mark.parametrize("how", sorted(EXPECTED))
def test_names_that_clash(spark, how):
    left = spark.range(3000).selectExpr("if(id % 2 = 0, 1, id) AS k", "id AS v", "id AS __a")
    right = spark.range(300).selectExpr("if(id % 3 = 0, 1, id * 2) AS k", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = cw.join_tables(left, right, "k", how=how, part_rows=50)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = cw.join_tables(left, right, "k", how=how, split_hot_keys=False)
    assert split.columns == plain.columns and rows(split) == rows(plain)
    if how not in ("left_semi", "left_anti"):
        assert plain.columns == ["k", "v", "__a", "v_right"]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def jobs_of(spark, call):
    """How many jobs run while the function is called, and its result."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        result = call()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("how", sorted(EXPECTED))
def test_small_tables_are_joined_without_a_job(spark, how):
    left = spark.range(3000).selectExpr("if(id % 2 = 0, 1, id) AS k", "id AS l")
    right = spark.range(300).selectExpr("id AS k", "id AS r")
    assert jobs_of(spark, lambda: cw.join_tables(left, right, "k", how=how))[0] == 0


@pytest.mark.parametrize("n", [4000, 40_000])
def test_a_part_of_a_key_is_bounded_at_any_size(spark, no_broadcast, n):
    # Half the left rows share a key, which the right table has too.
    left = spark.range(n).selectExpr("if(id % 2 = 0, -1, id) AS k", "id AS l")
    right = spark.range(n).selectExpr("if(id < 3, -1, id) AS k", "id AS r")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        joined = cw.join_tables(left, right, "k", how="left", part_rows=500)
        sizes = joined.where("k = -1").groupBy(F.spark_partition_id()).count()
        found = sizes.agg(F.count("*").alias("parts"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # A part makes three rows of each of its left rows; two parts may meet in one task by chance.
    assert found["all"] == 3 * n // 2 and found["most"] <= 3 * 500 * 3 and found["parts"] > n // 2 // 500 // 2


def test_a_split_join_reads_each_row_once(spark, no_broadcast, tmp_path):
    for name, sql in (("l", "if(id % 2 = 0, -1, id) AS k"), ("r", "if(id < 3, -1, id) AS k")):
        spark.range(5000).selectExpr(sql, f"id AS {name}").write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / x)) for x in "lr")
    for how in ("inner", "left", "right", "full"):
        text = cw.join_tables(left, right, "k", how=how, part_rows=100)._jdf.queryExecution().executedPlan().toString()
        # Each table once, and the kept hot keys once per side.
        assert text.count("FileScan") == 4 and "SortMergeJoin" in text
        assert text.count("Exchange hashpartitioning") == 2


def test_keys_of_different_types_are_split_alike(spark, no_broadcast):
    left = spark.range(600).selectExpr("cast(if(id % 2 = 0, 7, id) AS int) AS k", "id AS l")
    right = spark.range(600).selectExpr("cast(if(id % 3 = 0, 7, id) AS bigint) AS k", "id AS r")
    zero = spark.range(600).selectExpr("if(id % 2 = 0, 0.0D, if(id % 3 = 0, -0.0D, double(id))) AS k", "id AS r")
    for other in (right, zero):
        for how in sorted(EXPECTED):
            split = cw.join_tables(left, other, "k", how=how, part_rows=20)
            assert rows(split) == rows(cw.join_tables(left, other, "k", how=how, split_hot_keys=False))
    for how in sorted(EXPECTED):
        split = cw.join_tables(zero, zero.withColumnRenamed("r", "q"), "k", how=how, part_rows=20)
        assert rows(split) == rows(cw.join_tables(zero, zero.withColumnRenamed("r", "q"), "k", how=how, split_hot_keys=False))


def test_a_tie_of_most_rows_is_dealt_over_tasks(spark, no_broadcast):
    df = spark.range(0, 40_000, numPartitions=8).selectExpr("'g' AS g", "if(id % 10 < 9, 5, -id) AS x", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for pick, n in ((cw.pick_first_n, 3), (cw.pick_first_n, 20_000), (cw.pick_last_n, 4001)):
            picked = pick(df, "g", "x", n)
            sizes = [r["count"] for r in picked.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) >= 36_000 and max(sizes) <= 2 * sum(sizes) / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("sort", [cw.sort_asc, cw.sort_desc])
def test_filters_after_a_sort_reach_the_scan(spark, sort):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = cw.filter_equal(sort(orders, "o_totalprice"), "o_orderstatus", "F")
    assert "EqualTo(o_orderstatus,F)" in df._jdf.queryExecution().toString()


def test_random_previews_are_whole(spark):
    for n in (1, 50, 700):
        drawn = [r.row for r in cw.preview_random(spark.range(600), n, seed=3).collect()]
        assert len(drawn) == len(set(drawn)) == min(n, 600)


def test_join_spellings_and_checks(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(2, 1, 5)], "a int, c int, d int")
    assert cw.join_tables(left, right, ["a", "b"], ["c", "a"], "LEFT_OUTER").columns == ["a", "b", "d"]
    assert cw.join_tables(left, right, ["a", "b"], ["c", "a"], "semi").count() == 1
    with pytest.raises(ValueError, match="none of"):
        cw.join_tables(left, right, "a", how="cross")
    with pytest.raises(ValueError, match="same number"):
        cw.join_tables(left, right, ["a", "b"], ["a"])
    with pytest.raises(ValueError, match="other columns named"):
        cw.join_tables(left, right, "a", "d")
