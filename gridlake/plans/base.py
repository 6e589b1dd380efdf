"""What the modules of queries share: the registry itself and the common rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.sources.tables import OBSERVATIONS

FLAGSHIP = "area_bias_by_year"
QUERIES: dict = {}
SQL: dict[str, str] = {}
SPLITS = {"train": [1992, 1993, 1994, 1995, 1996], "validation": [1997], "test": [1998]}
EDGES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
_METRICS = """count(*) AS n, round(avg(abs(predicted - observed)), 6) AS mae, round(sqrt(avg((predicted - observed) ** 2)), 6) AS rmse,
 round(1 - sum((predicted - observed) ** 2) / nullif(sum(observed ** 2) - sum(observed) * sum(observed) / count(*), 0), 6) AS r2,
 round(sum(observed), 4) AS observed_area, round(sum(predicted), 4) AS predicted_area, round((sum(predicted) - sum(observed)) / nullif(sum(observed), 0), 6) AS area_bias"""


def Y():
    return F.col("observed")


def P():
    return F.col("predicted")


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, f"WITH {OBSERVATIONS} {sql}"
        return f

    return register
