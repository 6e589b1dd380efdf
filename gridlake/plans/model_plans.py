"""Model operators. Fits of many features have no SQL and are tested against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import models
from gridlake.plans.base import QUERIES, SPLITS, P, Y, query
from gridlake.sources.tables import observations, scan

ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


def fitted(name: str):
    """Register a query without SQL."""

    def register(f):
        QUERIES[name] = f
        return f

    return register


def vectors(spark, d):
    """Embeddings as 64 features, the label as target, and a split by id."""
    rows = scan(spark, d, "embeddings", "vec_id", "embedding", "label")
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 9, "validation").otherwise("test")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), split.alias("split"))


@query("train_mean_baseline", ", m AS (SELECT avg(observed) AS m FROM o WHERE year BETWEEN 1992 AND 1996) SELECT year, count(*) AS n, round(avg(abs(observed - m)), 6) AS mae, round(sqrt(avg((observed - m) ** 2)), 6) AS rmse FROM o, m GROUP BY 1")
def _(spark, d):
    rows = observations(spark, d)
    mean = F.broadcast(rows.where(classify.split_of_year(F.col("year"), SPLITS) == "train").agg(F.avg("observed").alias("m")))  # one row
    error = Y() - F.col("m")
    return rows.join(mean).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))


_WEIGHTS = [round(((i * 37) % 64 - 31.5) / 100, 3) for i in range(64)]


@query("linear_scores", f" SELECT vec_id, label, round(0.25 + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ([{', '.join(map(str, _WEIGHTS))}]::DOUBLE[])[i])), 5) AS score FROM embeddings")
def _(spark, d):
    rows = scan(spark, d, "embeddings", "vec_id", "embedding", "label")
    return rows.select("vec_id", "label", F.round(models.linear_score(F.col("embedding"), 0.25, _WEIGHTS), 5).alias("score"))


@query(
    "hurdle_policies",
    """, c AS (SELECT *, greatest(0, least(1, predicted * 1.2 - 0.1)) AS m FROM o), h AS (SELECT *, 'expected_value' AS policy, predicted * m AS composed FROM c UNION ALL SELECT *, 'hard_gate', CASE WHEN predicted >= 0.4 THEN m ELSE 0 END FROM c)
 SELECT policy, year, count(*) AS n, round(avg(abs(observed - composed)), 6) AS mae, round(sqrt(avg((observed - composed) ** 2)), 6) AS rmse, round(sum(composed) - sum(observed), 4) AS area_bias, count(*) FILTER (composed >= 0.1 AND observed >= 0.1) AS tp, count(*) FILTER (composed >= 0.1 AND observed < 0.1) AS fp, count(*) FILTER (composed < 0.1 AND observed >= 0.1) AS fn FROM h GROUP BY 1, 2""",
)
def _(spark, d):
    rows = models.hurdle(observations(spark, d), P(), P() * 1.2 - 0.1, 0.4)
    c, hit = F.col("composed"), F.col("composed") >= 0.1
    seen = Y() >= 0.1
    return rows.groupBy("policy", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(Y() - c)), 6).alias("mae"), F.round(F.sqrt(F.avg((Y() - c) * (Y() - c))), 6).alias("rmse"), F.round(F.sum(c) - F.sum(Y()), 4).alias("area_bias"),
        F.count_if(hit & seen).alias("tp"), F.count_if(hit & ~seen).alias("fp"), F.count_if(~hit & seen).alias("fn"),
    )


def _table(spark, rows: list[dict], schema: str):
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


_RIDGE = "alpha double, train_rmse double, validation_rmse double, selected boolean"


@fitted("ridge_alpha_grid")
def _(spark, d):
    m = models.moments(models.known_rows(vectors(spark, d)), F.col("split"))
    return _table(spark, models.select_ridge(m["train"], m["validation"], ALPHAS), _RIDGE)


@fitted("ridge_positives_only")
def _(spark, d):
    """The conditional model: fitted and selected on rows of a positive target alone."""
    m = models.moments(models.known_rows(vectors(spark, d).where("y > 0")), F.col("split"))
    return _table(spark, models.select_ridge(m["train"], m["validation"], ALPHAS), _RIDGE)


@fitted("ridge_scored")
def _(spark, d):
    """The selected ridge applied to every vector as an expression, its errors by split."""
    rows = vectors(spark, d)
    m = models.moments(models.known_rows(rows), F.col("split"))
    best = next(r for r in models.select_ridge(m["train"], m["validation"], ALPHAS) if r["selected"])
    error = F.col("y") - models.linear_score(F.col("x"), best["intercept"], best["weights"])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


@fitted("geographic_ridge")
def _(spark, d):
    """Place and year as the only features."""
    rows = observations(spark, d)
    split = classify.split_of_year(F.col("year"), {"train": list(range(1992, 1997)), "validation": [1997, 1998]})
    data = models.features_of(rows.withColumn("split", split).where("split IS NOT NULL"), ["row", "col", "year"], "observed", "weight")
    m = models.moments(data.withColumn("split", F.when(F.get("x", F.lit(2)) < 1997, "train").otherwise("validation")), F.col("split"))
    return _table(spark, models.select_ridge(m["train"], m["validation"], ALPHAS), _RIDGE)


@fitted("logistic_grid")
def _(spark, d):
    """Balanced logistic fits of 'label is 0' over a grid of penalties."""
    rows = models.known_rows(vectors(spark, d).withColumn("y", (F.col("y") == 0).cast("double"))).select("x", "y", "w", "split")
    part = lambda name: rows.where(F.col("split") == name).drop("split")
    return _table(spark, models.select_logistic(part("train"), part("validation"), [0.01, 1.0]), "c double, average_precision double, auroc double, selected boolean")


@fitted("platt_fitted")
def _(spark, d):
    """Calibration fitted on the validation year alone, its effect by year."""
    from gridlake.operators import binary

    rows = observations(spark, d).select("year", P().alias("p"), (Y() >= 0.5).alias("y"))
    slope, intercept = models.fit_platt(rows.where("year = 1997"), "p", F.col("y"))
    scored = rows.withColumn("c", binary.platt(F.col("p"), slope, intercept))
    brier = lambda c: F.avg((F.col(c) - F.col("y").cast("int")) * (F.col(c) - F.col("y").cast("int")))
    return scored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), brier("p").alias("raw_brier"), brier("c").alias("calibrated_brier"))


@fitted("principal_components")
def _(spark, d):
    """Centres of the labels' groups on two principal axes, and their distances to the group of label 0."""
    rows = models.known_rows(vectors(spark, d))
    mean, deviation, axes, _ = models.principal_axes(models.moments(rows, F.lit("all"))["all"])
    weights = axes / deviation
    scores = [models.linear_score(F.col("x"), float(-(w @ mean)), w).alias(f"pc{k}") for k, w in enumerate(weights, 1)]
    centres = rows.select("y", *scores).groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    zero = F.broadcast(centres.where("label = 0").select(F.col("pc1").alias("z1"), F.col("pc2").alias("z2")))  # one row
    return centres.join(zero, F.lit(True), "left").select("label", "n", "pc1", "pc2", F.hypot(F.col("pc1") - F.col("z1"), F.col("pc2") - F.col("z2")).alias("distance_to_zero"))
