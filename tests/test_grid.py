"""Operators on small tables whose results are known, against closed forms, and their plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import binary, labels, masks, metrics, models, ordered, sampling, spatial
from gridlake.plans import registry
from gridlake.sources import tables

SF = "/root/testdata/sf0.001"


def test_annual_labels_keep_all_null_stations(spark):
    area = [[0, 0, -1, 100, 999], [9, 0, -1, 200, 999], [45, 0, -1, -1, 999], [90, 0, -1, 50, 999], [10, 0, 30, 40, 999]]
    when = [(2018, 1), (2018, 2), (2018, 3), (2018, 4), (2019, 1)]
    rows = [(s, y, q, float(area[t][s])) for t, (y, q) in enumerate(when) for s in range(4)]
    cleaned = spark.createDataFrame(rows, "station int, year int, quarter int, area double").withColumn("area", classify.cleaned_area(F.col("area")))
    got = {(r["year"], r["station"]): r for r in labels.annual_labels(cleaned).collect()}
    first = got[2018, 0]
    assert (first["area_max"], first["fraction"], first["max_area_quarter"], first["valid_quarter_count"], first["nonzero_quarter_count"]) == (90.0, 0.1, 4, 4, 3)
    assert first["present_ge_10pct"] and not got[2018, 1]["present_gt0"] and got[2018, 1]["max_area_quarter"] == 1
    gone = got[2018, 2]
    assert gone["area_max"] is None and gone["max_area_quarter"] is None and gone["valid_quarter_count"] == 0 and not gone["present_gt0"]
    assert got[2018, 3]["valid_quarter_count"] == 3 and got[2018, 3]["max_area_quarter"] == 2
    summary = {r["year"]: r for r in labels.label_summary(labels.annual_labels(cleaned)).collect()}
    assert (summary[2018]["row_count"], summary[2018]["valid_count"], summary[2018]["missing_count"], summary[2018]["median"]) == (4, 3, 1, 90.0)


def test_domain_mask_cells(spark):
    rows = [(0, None, None, "no_data"), (1, 2.0, 0.0, "valid"), (2, 8.0, 0.0, "valid"), (3, -150.0, 150.0, "valid"), (4, -20.0, 20.0, "valid"), (5, -45.0, 45.0, "valid")]
    table = spark.createDataFrame(rows, "cell int, e double, d double, s string").withColumns(masks.domain_mask(F.col("e"), F.col("d"), F.col("s"), max_depth=60.0))
    assert [(r["reason"], r["plausible"], r["depth_bin"]) for r in table.orderBy("cell").collect()] == [
        ("qa_missing_crm", True, "qa_missing_crm"), ("retained_ambiguous_coast", True, "ambiguous_coast"), ("dropped_definite_land", False, "land_positive"),
        ("dropped_deep_water", False, "60m_plus"), ("retained_depth_0_60m", True, "0_40m"), ("retained_depth_0_60m", True, "40_60m"),
    ]


def test_mask_refuses_missing_and_double_rows(spark):
    mask = spark.createDataFrame([(1, True), (2, False)], "cell int, plausible boolean")
    rows = spark.createDataFrame([(1,), (2,)], "cell int")
    assert [r["cell"] for r in masks.apply_mask(rows, mask, "cell").collect()] == [1]
    assert masks.apply_mask(rows, mask, "cell", drop=False).count() == 2
    with pytest.raises(Exception, match="no mask row for cell 3"):
        masks.apply_mask(spark.createDataFrame([(3,)], "cell int"), mask, "cell").collect()
    with pytest.raises(Exception, match="two mask rows of one cell: 1"):
        masks.apply_mask(rows, mask.union(mask.where("cell = 1")), "cell").collect()


def test_sample_of_pinned_population(spark):
    rows = [(2018, i, True, "coast", "b") for i in range(3)] + [(2018, 100 + i, False, "coast", "b") for i in range(10)] + [(2018, 200 + i, False, "deep", "b") for i in range(10)]
    table = spark.createDataFrame(rows, "year int, cell long, seen boolean, reason string, bin string")
    take = lambda: sampling.quota_sample(table, F.col("seen"), ["year", "reason", "bin"], "cell", classify.year_score(F.col("cell"), F.col("year"), 7), [(F.col("reason") == "coast", 0.5, 1, None)], (0.1, 1, None))
    got = sorted((r["cell"], r["weight"]) for r in take().collect())
    assert got == sorted((r["cell"], r["weight"]) for r in take().collect())
    score = lambda i: ((i * 1103515245 + 7 + 2018 * 2654435761) % 2**32) / 2**32
    coast = sorted(range(100, 110), key=lambda i: (score(i), i))[:5]
    deep = min(range(200, 210), key=lambda i: (score(i), i))
    assert got == sorted([(0, 1.0), (1, 1.0), (2, 1.0), *[(i, 2.0) for i in coast], (deep, 10.0)])
    summary = {r["reason"]: r for r in sampling.stratum_summary(table, take(), ["year", "reason", "bin"]).collect()}
    assert (summary["coast"]["population"], summary["coast"]["sampled"], summary["deep"]["dropped"]) == (13, 8, 9)
    assert spark.range(1).select(classify.year_score(F.lit(7458361), F.lit(0), 0)).first()[0] == (7458361 * 1103515245 % 2**32) / 2**32


def test_splits_refuse_double_and_unknown_years(spark):
    with pytest.raises(ValueError, match="2019"):
        classify.checked_split(F.col("year"), {"a": [2018, 2019], "b": [2019]})
    rows = spark.createDataFrame([(2018,), (2020,)], "year int")
    with pytest.raises(Exception, match="no split for year 2020"):
        rows.select(classify.checked_split(F.col("year"), {"a": [2018]})).collect()


def test_grid_context_and_components(spark):
    cells = [(r, c, 3 <= r <= 5 and 3 <= c <= 5) for r in range(9) for c in range(9)]
    table = spark.createDataFrame(cells, "row int, col int, positive boolean")
    got = {(r["row"], r["col"]): r for r in spatial.context(table, "positive").collect()}
    assert [got[k]["edge_class"] for k in ((4, 4), (3, 3), (2, 2), (1, 1), (0, 0))] == ["positive_interior", "positive_edge", "zero_adjacent_to_positive", "near_positive_exterior", "far_zero_exterior"]
    assert got[2, 2]["count_3x3"] == 1 and got[0, 0]["share_3x3"] == 0 and got[1, 1]["share_5x5"] == 1 / 16
    parts = spatial.connected(table.where("positive"), 9).collect()
    assert {(r["component"], r["cells"], r["area"]) for r in parts} == {(30, 9, 8100.0)}
    snake = [(0, c) for c in range(40)] + [(r, 39) for r in range(1, 30)] + [(50, 50), (51, 51), (51, 49)]
    parts = spatial.connected(spark.createDataFrame(snake, "row int, col int"), 1000).collect()
    assert {(r["component"], r["cells"]) for r in parts} == {(0, 69), (50050, 3)}
    assert spatial.connected(spark.createDataFrame([], "row int, col int"), 10).count() == 0


def test_nearest_positive_in_rings(spark):
    rng = random.Random(4)
    cells = [(rng.randrange(300), rng.randrange(300)) for _ in range(400)] + [(5000, -2000)]
    positives = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(250, 20 + i) for i in range(60)]
    schema = "row int, col int"
    got = {(r["row"], r["col"]): r["distance"] for r in spatial.nearest_positive(spark.createDataFrame(cells, schema), spark.createDataFrame(positives, schema)).collect()}
    assert got.keys() == set(cells)
    for (r, c), d in got.items():
        assert d == pytest.approx(min(math.hypot(r - a, c - b) for a, b in positives))
    none = spatial.nearest_positive(spark.createDataFrame(cells, schema), spark.createDataFrame([], schema)).collect()
    assert all(r["distance"] is None for r in none)


def test_hexagons_hold_their_points(spark):
    side = 1000 / math.sqrt(3)
    points = [(random.Random(i).uniform(-9e3, 9e3), random.Random(-i).uniform(-9e3, 9e3)) for i in range(500)]
    table = spark.createDataFrame(points, "x double, y double")
    q, r = spatial.hexagon(F.col("x"), F.col("y"), side)
    x, y = spatial.hexagon_centre(F.col("q"), F.col("r"), side)
    got = table.select("x", "y", q.alias("q"), r.alias("r")).select("*", x.alias("cx"), y.alias("cy")).collect()
    centres = {(k["q"], k["r"]): (k["cx"], k["cy"]) for k in got}
    for k in got:
        own = math.hypot(k["x"] - k["cx"], k["y"] - k["cy"])
        assert own <= side + 1e-9 and all(own <= math.hypot(k["x"] - a, k["y"] - b) + 1e-6 for a, b in centres.values())


def test_projection_of_known_points(spark):
    # On the central meridian the easting is 500 km; the equator's northing is 0. The meridian arc to 45 degrees is
    # 4,984,944.378 m on WGS 84, times 0.9996.
    x, y = spatial.utm(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame([(-123.0, 0.0), (-123.0, 45.0), (-122.0, 37.0), (-124.0, 37.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert got[0] == pytest.approx((500000, 0), abs=1e-6)
    assert got[1] == pytest.approx((500000, 0.9996 * 4984944.378), abs=2e-3)
    assert got[2]["x"] - 500000 == pytest.approx(500000 - got[3]["x"]) and got[2]["y"] == pytest.approx(got[3]["y"])
    assert 88900 < got[2]["x"] - 500000 < 89100


def test_snapped_points_refuse_what_is_off_the_lattice(spark):
    good = [(i * 30.0 + 0.01, -j * 30.0, i, j) for i in range(4) for j in range(3)]
    got = spatial.snapped(spark.createDataFrame(good, "x double, y double, i int, j int"), "x", "y", 30.0, 0.05).collect()
    assert all((r["row"], r["col"], r["lattice_rows"], r["lattice_columns"]) == (r["j"], r["i"], 3, 4) for r in got)
    with pytest.raises(Exception, match="off the lattice"):
        spatial.snapped(spark.createDataFrame([*good, (7.0, 0.0, 0, 0)], "x double, y double, i int, j int"), "x", "y", 30.0, 0.05).collect()


def test_ordered_operators_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(1.0, 3.0, 900), 1)
    y = np.round(x + rng.normal(0, 2, 900), 1)
    table = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("b", None, 1.0), ("b", 2.0, float("nan")), ("c", 5.0, 5.0)], "k string, x double, y double")
    points = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r["k"]: r for r in ordered.percentiles(table, ["k"], "x", points).collect()}
    assert [got["a"][n] for n in points] == pytest.approx([np.percentile(x, 100 * q) for q in points.values()])
    assert got["b"]["p50"] == 2.0 and got["c"]["p99"] == 5.0
    ranks = {r["x"]: r["rank"] for r in ordered.average_ranks(table.where("k = 'a'"), [], "x").collect()}
    mean_rank = lambda v, all_: np.mean(np.flatnonzero(np.sort(all_) == v) + 1)
    assert all(ranks[v] == mean_rank(v, x) for v in set(x.tolist()))
    rx, ry = np.array([mean_rank(v, x) for v in x]), np.array([mean_rank(v, y) for v in y])
    rho = {r["k"]: r["spearman"] for r in ordered.spearman(table.where("k <> 'b'"), ["k"], "x", "y").collect()}
    assert rho["a"] == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and rho["c"] is None


def test_curves_of_a_tied_ranking(spark):
    rows = [(0.9, True), (0.8, True), (0.8, False), (0.4, True), (0.3, False), (0.1, False), (None, True)]
    table = spark.createDataFrame(rows, "p double, y boolean")
    got = ordered.areas(table, [], F.col("y"), "p").first()
    assert got["auroc"] == pytest.approx((3 + 2.5 + 2) / 9) and got["average_precision"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)
    alone = ordered.areas(table.where("y"), [], F.col("y"), "p").first()
    assert alone["auroc"] is None and alone["average_precision"] == 1.0
    measured = binary.binary_metrics(table, [], F.col("y"), "p", 0.5).first()
    assert (measured["n"], measured["tp"], measured["fp"], measured["fn"], measured["tn"]) == (6, 2, 1, 1, 2)
    error = binary.calibration_error(table, [], F.col("y"), "p").first()
    assert error["n"] == 6 and error["ece"] == pytest.approx((0.1 + 2 * 0.3 + 0.6 + 0.3 + 0.1) / 6)


def test_threshold_policies(spark):
    counts = spark.createDataFrame([(0.1, 5, 5, 0, 10), (0.5, 4, 1, 1, 10), (0.6, 4, 1, 1, 10), (0.9, 1, 0, 4, 10)], "threshold double, tp long, fp long, fn long, n long")
    got = {r["policy"]: (r["threshold"], r["status"].split("_")[0]) for r in binary.policy_thresholds(counts, 0.9).collect()}
    assert got == {"max_f1": (0.6, "selected"), "prevalence_match": (0.6, "selected"), "min_precision": (0.9, "selected")}
    strict = {r["policy"]: r["status"] for r in binary.policy_thresholds(counts, 1.1).collect()}
    assert strict["min_precision"] == "no_threshold_met_min_precision"


def test_bins_at_their_edges(spark):
    row = spark.range(1).select(
        classify.area_bins(F.lit(90.0)), classify.area_bins(F.lit(0.0)), classify.area_bins(F.lit(901.0)), classify.area_bins(F.lit(None).cast("double")),
        classify.threshold_bins(F.lit(90.0)), classify.threshold_bins(F.lit(900.0)), classify.threshold_bins(F.lit(89.0)), classify.residual_bins(F.lit(-90.0)), classify.residual_bins(F.lit(90.0)),
        classify.persistence(F.lit(1), F.lit(1)), classify.seasonality(F.lit(1), F.lit(1)), classify.probability_bins(F.lit(0.1)), classify.boolish(F.lit("Yes")), classify.without_nodata(F.lit(-999.0), [-999.0]),
    ).first()
    assert list(row) == ["(1, 90]", "000_zero", ">900", "missing", "[90, 225)", "900", "(0, 90)", "[-90, 90]", "[-90, 90]", "persistent_all_valid_quarters", "one_quarter_spike", "[.1, .25)", True, None]
    assert classify.bands("A00-A03") == ["A00", "A01", "A02", "A03"] and classify.bands("A00, A05") == ["A00", "A05"] and classify.depth_label(2.5) == "2p5"


def test_failure_class_of_four_cells(spark):
    rows = [(900.0, 0.8, 900.0, 720.0), (450.0, 0.2, 600.0, 120.0), (0.0, 0.9, 450.0, 405.0), (0.0, 0.1, 300.0, 30.0)]
    table = spark.createDataFrame(rows, "o double, p double, c double, e double")
    named = classify.failure_class(classify.failure_flags(F.col("o"), F.col("p"), F.col("c"), F.col("e"), 0.5, 90.0))
    assert [r[0] for r in table.select(named).collect()] == ["composition_shrinkage", "support_miss_positive", "high_confidence_wrong", "near_correct"]


def test_ridge_against_closed_form(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, -2]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=300)
    w = rng.uniform(0.5, 2, 300)
    rows = [(*map(float, r), float(t), float(v), "train" if i % 3 else "validation") for i, (r, t, v) in enumerate(zip(x, y, w, strict=True))] + [(None, 1.0, 1.0, 1.0, 1.0, "train")]
    table = spark.createDataFrame(rows, "a double, b double, c double, y double, w double, split string")
    data = models.features_of(table.withColumn("d", F.col("split")), ["a", "b", "c"], "y", "w")
    m = models.moments(table.select(F.array("a", "b", "c").alias("x"), "y", "w", "split").where("a IS NOT NULL"), F.col("split"))
    assert data.count() == 300 and m["train"].n == 200
    at = np.arange(300) % 3 != 0
    mean = np.average(x[at], axis=0, weights=w[at])
    dev = np.sqrt(np.average((x[at] - mean) ** 2, axis=0, weights=w[at]))
    z, ym = (x[at] - mean) / dev, np.average(y[at], weights=w[at])
    for alpha in (0.01, 10.0):
        beta = np.linalg.solve((z * w[at][:, None]).T @ z + alpha * np.eye(3), (z * w[at][:, None]).T @ (y[at] - ym)) / dev
        intercept, weights = models.ridge(m["train"], alpha)
        assert weights == pytest.approx(beta) and intercept == pytest.approx(ym - beta @ mean)
        error = y[~at] - intercept - x[~at] @ weights
        assert m["validation"].error(intercept, weights) == pytest.approx(math.sqrt(np.average(error**2, weights=w[~at])))
    chosen = models.select_ridge(m["train"], m["validation"], [100.0, 0.01, 1.0])
    assert sum(r["selected"] for r in chosen) == 1 and [r["alpha"] for r in chosen] == [0.01, 1.0, 100.0]
    scores = table.select(models.linear_score(F.array("a", "b", "c"), 1.0, [1.0, 2.0, 3.0]).alias("s")).collect()
    assert scores[0]["s"] == pytest.approx(1 + x[0] @ [1, 2, 3]) and scores[-1]["s"] is None


def test_logistic_gradient_and_platt(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)) * [1, 5] + [0, 3]
    y = (x @ [1.5, 0.2] + rng.logistic(size=400) > 1).astype(float)
    table = spark.createDataFrame([([float(v) for v in r], float(t), 1.0) for r, t in zip(x, y, strict=True)], "x array<double>, y double, w double")
    c = 0.5
    intercept, weights = models.logistic(table, c)
    mean, dev = x.mean(axis=0), x.std(axis=0)
    z, beta = (x - mean) / dev, weights * dev
    p = 1 / (1 + np.exp(-(z @ beta + intercept + weights @ mean)))
    s = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    assert np.abs(z.T @ (s * (p - y)) + beta / c).max() < 1e-2 and abs((s * (p - y)).sum()) < 1e-2
    scored = table.select((1 / (1 + F.exp(-models.linear_score(F.col("x"), 0.0, [1.5, 0.2])))).alias("p"), (F.col("y") == 1).alias("y"))
    slope, shift = models.fit_platt(scored, "p", F.col("y"))
    p, t = map(np.array, zip(*[(r["p"], float(r["y"])) for r in scored.collect()], strict=True))
    q = 1 / (1 + np.exp(-(shift + slope * np.log(p / (1 - p)))))
    assert abs((q - t).sum()) < 1e-2 and abs(((q - t) * np.log(p / (1 - p))).sum()) < 5e-2


def test_principal_axes_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    table = spark.createDataFrame([([float(v) for v in r], 0.0, 1.0) for r in x], "x array<double>, y double, w double")
    _, _, axes, shares = models.principal_axes(models.moments(table, F.lit("all"))["all"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.abs(axes) == pytest.approx(np.abs(v[:2]), abs=1e-8) and shares == pytest.approx((s**2 / (s**2).sum())[:2])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_fitted_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_hurdle_is_null_without_an_amount(spark):
    got = models.hurdle(spark.createDataFrame([(0.5, 2.0), (0.2, 0.5), (0.9, None)], "p double, m double"), F.col("p"), F.col("m"), 0.4).collect()
    assert [(r["policy"], r["composed"]) for r in got] == [("expected_value", 0.5), ("hard_gate", 1.0), ("expected_value", 0.1), ("hard_gate", 0.0), ("expected_value", None), ("hard_gate", None)]


def test_chosen_rows(spark):
    table = spark.createDataFrame([(i, float((i * 7) % 11 - 5)) for i in range(22)], "id int, v double")
    got = sampling.top_of_each_sign(table, "v", "id", 3).collect()
    want = sorted(((i * 7) % 11 - 5, i) for i in range(22))
    assert [r["id"] for r in got if r["side"] == "low"] == [i for _, i in want[:3]]
    assert [r["id"] for r in got if r["side"] == "high"] == [i for _, i in sorted(want, key=lambda p: (-p[0], p[1]))[:3]]
    some = sampling.by_priority(table, [("low", F.col("v") < -4), ("even", F.col("id") % 2 == 0)], "v", "id", 4).collect()
    evens = sorted((i for i in range(2, 22, 2)), key=lambda i: (-((i * 7) % 11 - 5), i))[:2]
    assert [(r["id"], r["bucket"], r["reasons"]) for r in some] == [(0, "low", "low;even"), (11, "low", "low"), *[(i, "even", "even") for i in evens]]


def test_conditions_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = registry.QUERIES["scan_pushed_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("GreaterThanOrEqual(l_quantity,25.0)", "EqualTo(l_returnflag,R)", "GreaterThanOrEqual(l_shipdate", "LessThanOrEqual(l_shipdate"))


def test_sinks_and_sources(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, name string, v double")
    tables.write_csv(table, f"{tmp_path}/c", ["id", "v"])
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", "id long, v double").collect())) == [(1, 2.5), (2, None)]
    tables.write_parts(table, f"{tmp_path}/p", "id")
    assert spark.read.parquet(f"{tmp_path}/p").where("id = 2").count() == 1
    assert tables.conform(table, "v float, id int").dtypes == [("v", "float"), ("id", "int")]
    with pytest.raises(ValueError, match="missing"):
        tables.conform(table, "w int")
    tables.write_manifest(spark, f"{tmp_path}/m", {"a": {"b": [1, None]}})
    assert tables.read_manifest(spark, f"{tmp_path}/m") == {"a": {"b": [1, None]}}


def test_merged_summaries(spark):
    parts = spark.createDataFrame([("x", 2, 1.0, 3.0), ("x", 6, 2.0, 1.0)], "k string, n long, m double, r double")
    got = metrics.combined(parts, ["k"], "n", ["m"], ["r"]).first()
    assert (got["n"], got["m"], got["r"]) == (8, 1.75, math.sqrt(3.0))


def test_ranges_hold_outliers_infinities_a_hot_value_and_no_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 100)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random(1500), [1e9, -1e300, np.inf, -np.inf, np.nan], np.full(3000, 0.25)])
    table = spark.createDataFrame([(float(v), bool(i % 3)) for i, v in enumerate(x)] + [(None, True)], "x double, y boolean")
    placed = ordered.ranges(table.select("x").distinct().dropna(), ["x"], 100)
    assert placed.groupBy("_range").count().agg(F.max("count")).first()[0] <= 100
    known = x[~np.isnan(x)]
    got = ordered.percentiles(table, [], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).first()
    assert list(got) == pytest.approx([np.percentile(known, q) for q in (10, 50, 90)])
    ranks = {r["x"]: r["rank"] for r in ordered.average_ranks(table, [], "x").collect()}
    assert ranks[0.25] == np.mean(np.flatnonzero(np.sort(known) == 0.25) + 1) and ranks[-np.inf] == 1 and ranks[np.inf] == len(known)
    keyed = table.withColumn("k", F.when(F.col("x") > 0.5, "a"))
    halves = {r["k"]: r["m"] for r in ordered.percentiles(keyed, ["k"], "x", {"m": 0.5}).collect()}
    assert halves == {"a": pytest.approx(np.median(known[known > 0.5])), None: pytest.approx(np.median(known[known <= 0.5]))}


def test_nearest_positive_of_a_dense_raster_in_strips(spark, monkeypatch):
    monkeypatch.setattr(spatial, "STRIP_ROWS", 5)
    rng = np.random.default_rng(2)
    found = rng.random((60, 45)) < 0.01
    cells = spark.createDataFrame([(r - 20, c - 10, bool(found[r, c])) for r in range(60) for c in range(45)], "row int, col int, y boolean")
    got = {(r["row"], r["col"]): r["distance"] for r in spatial.nearest_positive(cells.unionByName(cells), cells.where("y")).collect()}
    hits = np.argwhere(found)
    assert len(got) == 2700
    for r in range(60):
        for c in range(45):
            assert got[r - 20, c - 10] == pytest.approx(np.hypot(hits[:, 0] - r, hits[:, 1] - c).min())


def test_percentiles_count_only_values_near_the_wanted_ranks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 400)
    seen, running = [], ordered.running
    monkeypatch.setattr(ordered, "running", lambda df, *rest: (seen.append(df.count()), running(df, *rest))[1])
    rng = np.random.default_rng(5)
    values = np.r_[rng.lognormal(0, 3, 9000), np.repeat(7.25, 500), -rng.random(500), np.inf]
    rows = [(None if i % 3 == 0 else "b", float(x)) for i, x in enumerate(values)] + [("b", None), ("b", math.nan)]
    points = {"p00": 0.0, "p50": 0.5, "p95": 0.95}
    found = ordered.percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", points)
    got = {r["k"]: [r[n] for n in points] for r in found.collect()}
    for k in (None, "b"):
        own = [x for key, x in rows if key == k and x is not None and x == x]
        assert got[k] == pytest.approx([np.percentile(own, 100 * q) for q in points.values()])
    assert len(seen) == 1 and seen[0] < len(values) / 10


def test_buckets_of_values_ascend(spark):
    at = [float(k) for k in range(1, 256)]
    for cut in ([], at[:1], at[:15], at[:16], at[:40], at):
        rows = spark.createDataFrame([(x / 2,) for x in range(-2, 520)] + [(math.inf,)], "x double").select("x", ordered.bucket("x", cut).alias("b")).collect()
        assert [r["b"] for r in rows] == [sum(c <= r["x"] for c in cut) for r in rows]


def test_means_and_sums_just_at_a_threshold_reach_it_in_any_order(spark, tmp_path):
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate string"

    def read(name, groups):
        rows = [(i, 1, part, float(q), 100.0, "A", "1995-03-01") for i, (part, q) in enumerate((p, q) for p, found in groups for q in found)]
        table = spark.createDataFrame(rows, kinds).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).coalesce(1)
        table.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        return f"{tmp_path}/{name}"

    mean = [42, 24, 8, 44, 37]  # shares of mean 0.62; summed as they stand they fall short of it
    folder = read("means", [(0, mean), (10, mean[::-1]), (20, sorted(mean))])
    assert {r["col"]: r["positive"] for r in registry.QUERIES["grid_context"](spark, folder).collect()} == {0: True, 10: True, 20: True}
    assert registry.QUERIES["connected_components"](spark, folder).count() == 3
    total = [15, 8, 2]  # shares of sum 0.5
    folder = read("sums", [(0, total), (10, total[::-1]), (20, [15, 2, 8])])
    assert [tuple(r) for r in registry.QUERIES["previous_year_class"](spark, folder).collect()] == [("new", 3)]
