import duckdb
import pytest
from pyspark.sql import functions as F

from gridlake.operators import metrics, sampling
from gridlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer", "nation", "region", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(None if x != x else x for x in r) for r in got.select(*columns).collect())))
    want = sorted(map(repr, db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry.SQL[name]})").fetchall()))
    assert rows == want


def test_best_threshold_off_the_coarse_grid_and_ties(spark):
    assert registry.QUERIES["threshold_sweep_full"](spark, SF).count() == 99
    schema = "threshold double, tp long, fp long, fn long, f1 double"
    rows = [(0.1, 2, 2, 0, 0.666667), (0.2, 1, 0, 1, 0.666667), (0.37, 1, 0, 1, 0.666667), (0.5, 0, 0, 2, 0.0)]
    assert metrics.best_threshold(spark.createDataFrame(rows, schema)).collect() == [(0.37, 0.666667)]
    assert metrics.best_threshold(spark.createDataFrame([(0.1, 0, 3, 0, 0.0)], schema)).collect() == [(0.5, None)]


def test_quota_sample_keeps_observed_rows_and_grows(spark):
    rows = [(s, i, i < 50) for s, n in (("a", 1050), ("b", 60), (None, 53)) for i in range(n)]
    table = spark.createDataFrame(rows, "s string, id int, seen boolean")
    got = sampling.quota_sample(table, F.col("seen"), ["s"], "id", F.pmod(F.col("id") * 7, F.lit(1000)) / 1000.0, [(F.col("s") == "a", 0.105, 20, 200)], (0.05, 4, None)).collect()
    assert sum(r["seen"] for r in got) == 150 and all(r["weight"] == 1 for r in got if r["seen"])
    other = {s: sorted(r["id"] for r in got if r["s"] == s and not r["seen"]) for s in ("a", "b", None)}
    assert other["a"] == sorted(sorted(range(50, 1050), key=lambda i: (i * 7 % 1000, i))[:105])
    assert other["b"] == sorted(sorted(range(50, 60), key=lambda i: (i * 7 % 1000, i))[:4]) and other[None] == [50, 51, 52]
    assert {r["weight"] for r in got if r["s"] == "b" and not r["seen"]} == {2.5}


def test_leave_one_out_falls_back_to_source_and_all(spark):
    rows = [(1, 1, "a", 1.0), (1, 2, "a", 3.0), (2, 1, "a", 8.0), (3, 1, "b", 5.0), (4, 1, None, 7.0), (None, 1, None, 9.0), (1, 3, "a", None)]
    got = metrics.leave_one_out_chain(spark.createDataFrame(rows, "cell int, year int, source string, v double"), "cell", "source", "v").collect()
    assert {(r["cell"], r["year"]): (r["loo_mean"], r["reason"]) for r in got} == {
        (1, 1): (3.0, "cell"), (1, 2): (1.0, "cell"), (2, 1): (2.0, "label_source"), (3, 1): (5.6, "global"),
        (4, 1): (9.0, "label_source"), (None, 1): (7.0, "label_source"), (1, 3): (2.0, "cell"),
    }
