"""Recipes, streams, sources and previews."""

import json
import re

import pytest
from pyspark.sql import functions as F

import colwright as cw
from colwright import Step
from colwright.plans.registry import OPERATORS, RECORDED_IDS, operator


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, float(i % 7 - 2), None if i % 5 == 0 else i / 4, "ab c"[i % 3 :]) for i in range(60)]
    return spark.createDataFrame(rows, "i int, v double, w double, t string").cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


STEPS = [
    Step("replace_null_median", "w"),
    Step("replace_negative_mean", "v"),
    Step("upper", "t"),
    Step("scale_standard", "w", {"new_column": "sw"}),
    Step("scale_minmax", "v", {"new_column": "sv"}),
    Step("filter_greater", "v", {"value": 0}),
    Step("bin_quantile", "w", {"new_column": "q"}),
    Step("encode_category", "t", {"new_column": "code", "after": "t"}),
    Step("replace_zero_mean", "sv"),
    Step("scale_robust", "sv", {"new_column": "rv"}),
    Step("drop_columns", ["v", "w"]),
]


def by_hand(df):
    df = cw.replace_negative_mean(cw.replace_null_median(df, "w"), "v")
    df = cw.scale_standard(cw.upper(df, "t"), "w", "sw")
    df = cw.filter_greater(cw.scale_minmax(df, "v", "sv"), "v", 0)
    df = cw.encode_category(cw.bin_quantile(df, "w", "q"), "t", "code", after="t")
    return cw.drop_columns(cw.scale_robust(cw.replace_zero_mean(df, "sv"), "sv", "rv"), ["v", "w"])


def test_recipe_equals_chained_calls(df):
    same(cw.apply_recipe(df, STEPS), by_hand(df))


def test_fitted_recipe_equals_recipe_and_survives_storage(spark, df, tmp_path):
    fitted = cw.fit_recipe(df, STEPS)
    assert [s.op for s in fitted] == [s.op for s in STEPS]
    same(cw.apply_recipe(df, fitted), by_hand(df))
    cw.save_recipe(spark, fitted, str(tmp_path / "recipe"))
    loaded = cw.load_recipe(spark, str(tmp_path / "recipe"))
    where = re.compile(r'"table": "[^"]*"')
    for ours, theirs in zip(loaded, fitted, strict=True):
        assert (ours.op, ours.column, dict(ours.args)) == (theirs.op, theirs.column, dict(theirs.args))
        assert where.sub("", json.dumps(ours.params)) == where.sub("", json.dumps(theirs.params))
    same(cw.apply_recipe(df, loaded), by_hand(df))


def test_fitted_recipe_keeps_its_parameters_on_other_data(spark, df):
    fitted = cw.fit_recipe(df, [Step("scale_minmax", "v", {"new_column": "s"}), Step("split_column", "t", {"delimiter": " "})])
    other = spark.createDataFrame([(1, 23.0, None, "x")], df.schema)
    row = cw.apply_recipe(other, fitted).first()
    assert (row.s, row.column_0, row.column_1) == (4.1667, "x", None)


def test_fits_on_the_same_table_share_a_scan(df, spark):
    steps = [
        Step("replace_null_mean", "w"),
        Step("upper", "t"),
        Step("scale_robust", "v", {"new_column": "s"}),
        Step("replace_zero_mean", "v"),
    ]
    group = "shared-scan"
    spark.sparkContext.setJobGroup(group, "")
    cw.fit_recipe(df, steps[:2] + steps[3:])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group + "-one", "")
    cw.fit_recipe(df, steps[:1])
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup(group + "-one"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_recipe_without_fits_runs_no_job(df, spark):
    fitted = cw.fit_recipe(df, [Step("replace_null_mean", "w"), Step("scale_minmax", "w", {"new_column": "s"})])
    spark.sparkContext.setJobGroup("lazy", "")
    cw.apply_recipe(df, [*fitted, Step("upper", "t")])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_dependent_fits_keep_the_plan_flat(df):
    steps = [Step("replace_negative_mean", "v"), Step("replace_zero_mean", "v")] * 6
    result = cw.apply_recipe(df, steps)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") <= 8
    assert result.count() == 60


def test_join_step_takes_a_named_table(spark, df):
    names = spark.createDataFrame([(-2.0, "low"), (4.0, "high")], "v2 double, name string")
    step = Step("join_tables", "v", {"right": "names", "right_on": "v2", "how": "left"})
    result = cw.apply_recipe(df, [step], {"names": names})
    assert result.count() == 60 and result.columns == ["v", "i", "w", "t", "name"]
    with pytest.raises(ValueError, match="no table 'names'"):
        cw.apply_recipe(df, [step])


def test_errors_name_the_step(df):
    with pytest.raises(ValueError, match="unknown operator 'nope'"):
        cw.apply_recipe(df, [Step("nope", "v")])
    with pytest.raises(ValueError, match="step upper on zzz"):
        cw.apply_recipe(df, [Step("upper", "zzz")])


def test_recorded_ids_stand_for_operators(df):
    assert all(operator(key)[0] in OPERATORS for key in RECORDED_IDS)
    same(
        cw.apply_recipe(df, [Step("upper_case", "t"), Step("filter_lesser", "v", {"value": "1"}), Step("delete", "w")]),
        cw.drop_column(cw.filter_less(cw.upper(df, "t"), "v", 1), "w"),
    )


def test_every_operator_is_in_the_registry():
    others = {  # not table to table, or no step of a recipe
        "Step", "apply_recipe", "apply_to_stream", "column_count", "fit_recipe", "load_recipe", "read_csv", "read_parquet",
        "owned_tables", "restore_table", "save_recipe", "save_table", "steps_of", "steps_table",
    }
    public = {name for name, value in vars(cw).items() if callable(value)}
    assert public - others == set(OPERATORS)


def test_statistics_and_previews_close_a_recipe(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "v int, t string")
    up = Step("upper", "t")
    same(cw.apply_recipe(df, [up, Step("distinct_count", "t")]), cw.distinct_count(cw.upper(df, "t"), "t"))
    same(cw.apply_recipe(df, [up, Step("column_profile", "")]), cw.column_profile(df))
    same(cw.apply_recipe(df, [up, Step("preview", "", {"n": 2})]), cw.preview(cw.upper(df, "t"), 2))
    with pytest.raises(ValueError, match="ends a recipe"):
        cw.apply_recipe(df, [Step("row_count", ""), up])


def test_saved_recipes_carry_their_categories(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    fitted = cw.fit_recipe(df, [Step("encode_category", "t", {"new_column": "code"})])
    cw.save_recipe(spark, fitted, f"{tmp_path}/recipe")
    (tmp_path / "recipe").rename(tmp_path / "moved")
    loaded = cw.load_recipe(spark, f"{tmp_path}/moved")
    assert loaded[0].params["categories"]["table"].startswith(f"{tmp_path}/moved")
    assert sorted(map(tuple, cw.apply_recipe(df, loaded).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_deduplicated_rows_are_those_that_are_scaled(spark):
    df = spark.range(2000).selectExpr("id % 50 AS k", "cast((id * 7919) % 2003 AS double) AS v").repartition(7)
    scaled = cw.apply_recipe(df, [Step("deduplicate", "k"), Step("scale_minmax", "v", {"new_column": "s"})])
    assert all(0 <= r.s <= 1 for r in scaled.collect()) and {r.s for r in scaled.collect()} >= {0.0, 1.0}


# Streams


def test_fitted_recipe_on_a_stream_equals_batch(spark, df, tmp_path):
    cw.save_table(df.repartition(3), str(tmp_path / "in"))
    table = cw.read_parquet(spark, str(tmp_path / "in"))
    steps = [s for s in STEPS if s.op != "split_column"] + [Step("split_column", "t", {"delimiter": " ", "n": 3})]
    fitted = cw.fit_recipe(table, steps)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = cw.apply_to_stream(stream, fitted).writeStream.format("parquet").outputMode("append")
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    query.start(str(tmp_path / "out")).awaitTermination(120)
    result = cw.read_parquet(spark, str(tmp_path / "out"))
    same(result, cw.apply_recipe(table, fitted))


def test_stream_refuses_shuffles_and_open_fits(spark, df, tmp_path):
    cw.save_table(df, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="sort_asc"):
        cw.apply_to_stream(stream, [Step("sort_asc", "v")])
    with pytest.raises(ValueError, match="scale_minmax"):
        cw.apply_to_stream(stream, [Step("scale_minmax", "v", {"new_column": "s"})])
    with pytest.raises(ValueError, match="not a streaming table"):
        cw.apply_to_stream(df, [])


# Sources, sinks, previews


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2.5,x\n2,,\n")
    df = cw.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2.5, "x"), (2, None, None)]
    given = cw.read_csv(spark, str(tmp_path / "t.csv"), "a bigint, b string, c string")
    assert given.dtypes == [("a", "bigint"), ("b", "string"), ("c", "string")]


def test_save_table_overwrites_and_partitions(spark, df, tmp_path):
    path = str(tmp_path / "t")
    cw.save_table(df, path)
    cw.save_table(df.where("i < 10"), path, partition_by=["t"])
    assert cw.read_parquet(spark, path).count() == 10
    with pytest.raises(ValueError, match="no such column"):
        cw.save_table(df, path, partition_by=["zzz"])


def test_previews(spark, df):
    first = [json.loads(r.row) for r in cw.preview(cw.sort_asc(df, "i"), 3).collect()]
    assert [r["i"] for r in first] == [0, 1, 2] and first[0] == {"i": 0, "v": -2.0, "t": "ab c"}
    assert cw.preview(df).count() == 60
    assert cw.preview_random(df).count() == 60
    big = spark.range(50_000).withColumn("x", F.col("id") * 2)
    drawn = [json.loads(r.row)["id"] for r in cw.preview_random(big, 200, seed=4).collect()]
    assert len(set(drawn)) == 200 and 15_000 < sum(drawn) / 200 < 35_000
    assert drawn == [json.loads(r.row)["id"] for r in cw.preview_random(big, 200, seed=4).collect()]
    assert cw.preview_random(spark.range(0)).count() == 0


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    from colwright.sources.shared import shared_path

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_path(spark, "x").startswith(configured)
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_only_local_sessions_may_keep_tables_in_their_warehouse():
    from types import SimpleNamespace

    from colwright.sources.shared import shared_path

    values = {"spark.sql.warehouse.dir": "store://warehouse"}
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local[2]")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: values.get(key)), sparkContext=context)
    assert shared_path(session, "x").startswith("store://warehouse/_kept/x-")
    context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session, "x")
    values["spark.checkpoint.dir"] = "store://shared/"
    assert shared_path(session, "x").startswith("store://shared/x-")


@pytest.mark.parametrize("by", [[], ["t"]])
def test_a_table_is_saved_over_itself(spark, df, tmp_path, by):
    path = str(tmp_path / "table")
    cw.save_table(df, path, partition_by=by)
    for _ in range(2):
        old = cw.read_parquet(spark, path)
        cw.save_table(old.withColumn("i", F.col("i") + 1), path, partition_by=by)
    saved = cw.read_parquet(spark, path)
    assert sorted(r.i for r in saved.collect()) == sorted(r.i + 2 for r in df.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


@pytest.mark.parametrize("by", [[], ["t"]])
def test_a_failing_write_leaves_the_old_rows(spark, df, tmp_path, by):
    path = str(tmp_path / "table")
    cw.save_table(df, path, partition_by=by)
    bad = cw.read_parquet(spark, path).withColumn("i", F.when(F.col("i") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("i")))
    with pytest.raises(Exception, match="no"):
        cw.save_table(bad, path, partition_by=by)
    assert cw.read_parquet(spark, path).count() == df.count()
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_an_overwrite_that_was_cut_off_is_undone(spark, df, tmp_path):
    path = tmp_path / "table"
    cw.save_table(df, str(path))
    path.rename(tmp_path / ".table.old-1")
    assert cw.restore_table(spark, str(path)) and not cw.restore_table(spark, str(path))
    assert cw.read_parquet(spark, str(path)).count() == df.count()
    path.rename(tmp_path / ".table.old-2")
    cw.save_table(df.limit(5), str(path))
    assert cw.read_parquet(spark, str(path)).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_other_modes_are_those_of_spark(spark, df, tmp_path):
    path = str(tmp_path / "table")
    cw.save_table(df, path)
    cw.save_table(df, path, mode="append")
    assert cw.read_parquet(spark, path).count() == 2 * df.count()
    cw.save_table(df, path, mode="ignore")
    with pytest.raises(Exception, match="exists"):
        cw.save_table(df, path, mode="error")


def test_owned_tables_are_removed(spark, df, tmp_path):
    from pathlib import Path

    from colwright.sources.shared import shared_path

    folder = Path(shared_path(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    with cw.owned_tables(spark):
        assert cw.encode_category(df, "t", "code").count() == df.count()
        with cw.owned_tables(spark):
            assert cw.pick_first_n(df, "t", "i", 2).count() > 0
        assert {p.name for p in folder.iterdir()} > before
    assert {p.name for p in folder.iterdir()} == before


def test_fits_after_a_join_read_its_inputs_once(spark, tmp_path):
    spark.range(2000).selectExpr("id AS k", "id % 97 AS x").write.parquet(str(tmp_path / "left"))
    spark.range(500).selectExpr("id AS k", "id % 7 AS y").write.parquet(str(tmp_path / "right"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    steps = [
        Step("join_tables", "k", {"right": "r"}),
        Step("scale_minmax", "x", {"new_column": "a"}),
        Step("filter_greater", "a", {"value": 0.1}),
        Step("scale_standard", "a", {"new_column": "b"}),
        Step("filter_less", "b", {"value": 2.0}),
        Step("replace_null_mean", "b"),
    ]
    with cw.owned_tables(spark):
        out = cw.apply_recipe(left, steps, {"r": right})
        # The rows after the join are kept once; three rounds of fits and the result read them.
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("FileScan") == 1
        plain = cw.scale_minmax(cw.join_tables(left, right, "k"), "x", "a")
        plain = cw.scale_standard(cw.filter_greater(plain, "a", 0.1), "a", "b")
        assert out.count() == cw.filter_less(plain, "b", 2.0).count() > 0
