"""Mergeable states, context families, windows, splits and stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import families, masks, metric_state, spatial, splits
from gridlake.sources import tables

KEYS = ["year", "label_source"]
ROWS = "year int, label_source string, observed double, predicted double, observed_area double, predicted_area double"


def predictions(n, seed=1):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, float("nan"), 0.0, rng.random(), rng.random()])
    return [(rng.choice([2000, 2001, None]), rng.choice(["observed", "assumed_background", None]), some(), some(), some(), some()) for _ in range(n)]


def told(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_any_cut_into_batches_finishes_as_one_pass(spark, tmp_path):
    rows = predictions(300)
    table = spark.createDataFrame(rows, ROWS)
    whole = told(metric_state.finished(metric_state.partial(table, KEYS), KEYS))
    for sizes in ((300,), (1, 0, 99, 200), (100, 100, 100)):
        path, at = f"file://{tmp_path}/s{len(sizes)}-{sizes[0]}", 0
        for batch, n in enumerate(sizes):
            metric_state.append(spark.createDataFrame(rows[at : at + n], ROWS), batch, path, KEYS)
            at += n
        assert told(metric_state.finished(metric_state.state_at(spark, path, KEYS), KEYS)) == whole
    # A batch that is written again replaces itself.
    metric_state.append(spark.createDataFrame(rows[:100], ROWS), 0, path, KEYS)
    assert told(metric_state.finished(metric_state.state_at(spark, path, KEYS), KEYS)) == whole
    by_year = metric_state.merged(metric_state.partial(table, KEYS), ["year"])
    assert told(by_year.select("year", "rows", "positives", "background_predicted_area_max")) == told(
        metric_state.partial(table, ["year"]).select("year", "rows", "positives", "background_predicted_area_max")
    )


def test_a_stream_of_files_finishes_as_one_pass_and_goes_on_where_it_stopped(spark, tmp_path):
    rows = predictions(120, 2)
    files, states, progress = (f"file://{tmp_path}/{n}" for n in ("in", "states", "progress"))
    run = lambda: metric_state.stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(files), states, progress, KEYS).awaitTermination()
    for part in (rows[:50], rows[50:70]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(files)
    run()
    spark.createDataFrame(rows[70:], ROWS).coalesce(1).write.mode("append").parquet(files)
    run()
    want = metric_state.finished(metric_state.partial(spark.createDataFrame(rows, ROWS), KEYS), KEYS)
    assert told(metric_state.finished(metric_state.state_at(spark, states, KEYS), KEYS)) == told(want)
    assert spark.read.parquet(states).select("batch").distinct().count() == 3


def test_families_equal_single_groupings(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice(["x", None]), rng.random()) for _ in range(200)]
    table = spark.createDataFrame(rows, "base string, one int, two string, v double")
    found = families.families(table, ["base"], {"one": F.col("one"), "two": F.col("two")}, {"n": F.count(F.lit(1)), "v": F.sum("v")})
    got = {(r["base"], r["context_type"], r["context_value"]): (r["n"], round(r["v"], 9)) for r in found.collect()}
    want = {}
    for base, one, two, v in rows:
        for kind, value in (("one", one), ("two", two)):
            key = (base, kind, "missing" if value is None else str(value))
            n, s = want.get(key, (0, 0.0))
            want[key] = (n + 1, s + v)
    assert got == {k: (n, round(s, 9)) for k, (n, s) in want.items()}


def test_windows_and_edge_measures_on_a_pinned_grid(spark):
    # A solid 3 x 3 block of positives, one alone, predictions one column to the right.
    seen = {(r, c) for r in range(3) for c in range(3)} | {(9, 9)}
    said = {(r, c + 1) for r in range(3) for c in range(3)}
    cells = [(1, r, c, (r, c) in seen, (r, c) in said) for r in range(-1, 12) for c in range(-1, 12)]
    table = spark.createDataFrame(cells, "k int, row int, col int, observed boolean, predicted boolean")
    around = families.windows(table, ["k"], ["observed", "predicted"])
    got = {(r["row"], r["col"]): r for r in around.collect()}
    assert len(got) == len(cells)
    count = lambda of, r, c, reach: sum((r + i, c + j) in of for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))
    assert all((x["observed_3x3"], x["predicted_5x5"]) == (count(seen, *at, 1), count(said, *at, 2)) for at, x in got.items())
    no = F.lit(False)
    measures = families.edge_measures(F.col("observed"), F.col("predicted"), no, no, {"r": F.lit(1.0)})
    row = around.groupBy("k").agg(*[m.alias(n) for n, m in measures.items()]).first()
    assert (row["false_positive_count"], row["fp_adjacent_observed_rate"], row["fp_predicted_edge_count"]) == (3, 1.0, 3)
    assert (row["false_negative_count"], row["fn_isolated_positive_count"], row["fn_positive_edge_or_isolated_rate"]) == (4, 1, 1.0)
    with pytest.raises(Exception, match="occurs twice"):
        families.windows(table.unionByName(table), ["k"], ["observed"]).collect()


def test_manifest_keys_copies_and_refusals(spark):
    years = {"train": [1], "test": [2]}
    rows = spark.createDataFrame([("r", 1, 5), ("r", 2, 6), (None, 2, 7)], "source string, year int, cell int")
    keys = [["source", "year", "cell"], ["year", "cell"]]
    manifest = spark.createDataFrame([(1, 5, "test", False)] * 2 + [(2, 6, "test", True), (2, 7, "train", True)], "year int, cell int, split string, used boolean")
    got = {r["cell"]: (r["split"], r["used"], r["drop_reason"]) for r in splits.attach(rows, manifest, keys, years).collect()}
    assert got == {5: ("test", False, ""), 6: ("test", True, ""), 7: ("train", True, "")}
    assert splits.strongest_key(rows, manifest, keys) == ["year", "cell"] and splits.strongest_key(rows, manifest.drop("cell"), keys) == []
    with pytest.raises(Exception, match="no row for key"):
        splits.attach(rows, manifest.where("cell <> 7"), keys, years).collect()
    lenient = splits.attach(rows, manifest.where("cell <> 7"), keys, years, allow_missing=True).where("cell = 7").first()
    assert (lenient["split"], lenient["used"], lenient["drop_reason"]) == ("test", True, "year_split_fallback")
    twice = manifest.unionByName(spark.createDataFrame([(1, 5, "train", False)], manifest.schema))
    for refused in (lambda: splits.attach(rows, twice, keys, years), lambda: masks.attach_split(rows, twice, ["year", "cell"], years)):
        with pytest.raises(Exception, match="two rows of one key"):
            refused().collect()
    with pytest.raises(Exception, match="no split for year"):
        splits.attach(rows, manifest.drop("year", "cell"), keys, {"train": [1]}).collect()
    with pytest.raises(ValueError, match="two splits"):
        splits.attach(rows, manifest, keys, {"train": [1], "test": [1]})
    assert masks.attach_split(rows, manifest, ["year", "cell"], years).count() == 3


def test_only_the_target_region_is_evaluated(spark):
    rows = spark.createDataFrame([("a", "train", True, ""), ("a", "test", True, ""), ("b", "test", True, ""), (None, "test", False, "x"), ("b", "train", True, "")], "region string, split string, used boolean, drop_reason string")
    got = [(r["region"], r["used"], r["drop_reason"]) for r in splits.only_target_region(rows, "region", "a").collect()]
    assert got == [("a", True, ""), ("a", True, ""), ("b", False, "non_target_region_eval"), (None, False, "x;non_target_region_eval"), ("b", True, "")]
    assert splits.only_target_region(rows, "region", None) is rows
    with pytest.raises(ValueError):
        splits.only_target_region(rows, "nowhere", "a")


def test_climatology_uses_training_years_and_falls_back(spark):
    rows = [(1, 1, "a", 1.0), (1, 2, "a", 3.0), (1, 9, "a", 50.0), (2, 1, "a", 8.0), (3, 9, "b", 5.0), (4, 9, None, 7.0), (5, 2, None, 9.0), (1, 1, "a", None)]
    table = spark.createDataFrame(rows, "cell int, year int, source string, v double")
    got = splits.climatology(table, ["cell"], "source", "v", F.col("year") < 9).collect()
    loo, mean, source, every = "cell_training_mean_leave_one_year_out", "cell_training_mean", "label_source_training_mean", "global_training_mean"
    assert {(r["cell"], r["year"], r["v"]): (r["prediction"], r["reason"]) for r in got} == {
        (1, 1, 1.0): (3.0, loo), (1, 1, None): (3.0, loo), (1, 2, 3.0): (1.0, loo), (1, 9, 50.0): (2.0, mean),
        (2, 1, 8.0): (4.0, source), (3, 9, 5.0): (5.25, every), (4, 9, 7.0): (9.0, source), (5, 2, 9.0): (9.0, source),
    }


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    rows = spark.range(1000).select("id", (F.col("id") % 10).cast("int").alias("year"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    tables.write_parts(rows, path, "year", "source")
    tables.replace_parts(rows.where("year = 4 AND source = 'a' AND id < 100"), path, "year", "source")
    found = tables.read_parts(spark, path)
    assert found.where("year = 4 AND source = 'a'").count() == 3 and found.where("year = 4 AND source = 'b'").count() == 67 and found.where("year = 5").count() == 100
    chosen = found.where("year = 4 AND source = 'b'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "year" in filters and "source" in filters
    files = [r[0] for r in chosen.select(F.input_file_name()).distinct().collect()]
    assert files and all("year=4/source=b" in f for f in files)
    small = tables.saved(spark.createDataFrame([(4, 1), (5, 0)], "year int, wanted int"), "years")
    joined = found.join(F.broadcast(small.where("wanted = 1")), "year")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower() and joined.count() == 70


def test_projection_there_and_back(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(-126, -120), rng.uniform(0, 60)) for i in range(300)]
    table = spark.createDataFrame(points, "i int, lon double, lat double")
    east, north = spatial.utm(F.col("lon"), F.col("lat"))
    lon, lat = spatial.utm_inverse(F.col("e"), F.col("n"))
    got = table.select("i", "lon", "lat", east.alias("e"), north.alias("n")).select("lon", "lat", lon.alias("x"), lat.alias("y")).collect()
    assert all(abs(r["lon"] - r["x"]) < 9e-9 and abs(r["lat"] - r["y"]) < 9e-9 for r in got)  # a millimetre
