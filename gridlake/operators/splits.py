"""Membership of rows in splits, policies on it, and climatology by training years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators.joins import one_to_one

#: What a manifest may say of a row besides its split.
NOTES = ("used", "drop_reason")


def strongest_key(rows: DataFrame, manifest: DataFrame, candidates: list[list[str]]) -> list[str]:
    """The first of candidates whose columns both tables have; none: an empty list."""
    both = set(rows.columns) & set(manifest.columns)
    return next((list(c) for c in candidates if both.issuperset(c)), [])


def attach(rows: DataFrame, manifest: DataFrame, candidates: list[list[str]], year_splits: dict[str, list[int]], allow_missing: bool = False, any_year: bool = False) -> DataFrame:
    """rows with split, used and drop_reason of the manifest's row of the same key, the strongest of candidates.

    Exact copies in the manifest count once; two different rows of one key stop the job. A row that the manifest lacks
    stops it too, unless allow_missing: then it is used, in the split of its year, and its reason is year_split_fallback.
    Where the tables share no key, all rows are split by year. A year of no split stops the job (any_year: its split is
    null), a year of two is refused at once. Null keys meet no manifest row.
    """
    by_year = classify.split_of_year(F.col("year"), year_splits) if any_year else classify.checked_split(F.col("year"), year_splits)
    if "split" not in manifest.columns:
        raise ValueError("the manifest has no column split")
    keys = strongest_key(rows, manifest, candidates)
    if not keys:
        return rows.withColumns({"split": by_year, "used": F.lit(True), "drop_reason": F.lit("")})
    given = manifest.select(*keys, F.col("split").alias("_split"), *[F.col(c).alias(f"_{c}") for c in NOTES if c in manifest.columns]).distinct()
    met = one_to_one(rows, given.withColumn("_met", F.lit(True)), keys, required=F.lit(not allow_missing))
    known = F.col("_met").isNotNull()

    def noted(name: str, default, fallback) -> Column:
        said = F.coalesce(f"_{name}", F.lit(default)) if name in manifest.columns else F.lit(default)
        return F.when(known, said).otherwise(F.lit(fallback))

    out = met.withColumns(
        {
            "split": F.when(known, F.col("_split")).otherwise(by_year),
            "used": noted("used", True, True),
            "drop_reason": noted("drop_reason", "", "year_split_fallback"),
        }
    )
    return out.drop("_split", "_met", *[f"_{c}" for c in NOTES])


def only_target_region(rows: DataFrame, region: str, target: str | None) -> DataFrame:
    """rows (split, used, drop_reason) where rows of other regions count for training alone: outside it they are not used,
    and say so. Without a target nothing changes; a null region is another region."""
    if target is None:
        return rows
    if region not in rows.columns:
        raise ValueError(f"a target region needs the column {region}")
    other = (F.col("split") != "train") & ~F.col(region).eqNullSafe(F.lit(target))
    reason = F.concat_ws(";", F.nullif(F.col("drop_reason"), F.lit("")), F.when(other, F.lit("non_target_region_eval")))
    return rows.withColumns({"used": F.col("used") & ~F.coalesce(other, F.lit(False)), "drop_reason": reason})


def climatology(rows: DataFrame, keys: list[str], source: str, value: str, train: Column) -> DataFrame:
    """rows with prediction and reason: the mean of the cell's (keys') training rows, for a training row without those of
    its own year; else the training mean of its source (null: 'unknown'); else that of all training rows.

    Sums and counts by cell, cell and year, and source are aggregated apart and joined: no cell's rows are gathered. Null
    values are in no mean and get a prediction; null keys are keys like others.
    """
    known = F.when(F.coalesce(train, F.lit(False)), F.col(value))
    named = rows.withColumns({"_source": F.coalesce(source, F.lit("unknown")), "_known": known, "_train": F.coalesce(train, F.lit(False))})
    sums = lambda a: [F.sum("_known").alias(f"_{a}s"), F.count("_known").alias(f"_{a}n")]

    def met(table: DataFrame, by: list[str], name: str) -> DataFrame:
        found = named.groupBy(*[F.col(k).alias(f"_{name}{k}") for k in by]).agg(*sums(name))
        same = F.lit(True)
        for k in by:
            same &= F.col(k).eqNullSafe(F.col(f"_{name}{k}"))
        return table.join(found, same, "left").drop(*[f"_{name}{k}" for k in by])

    table = met(met(met(named, keys, "c"), [*keys, "year"], "y"), ["_source"], "l")
    whole = named.agg(F.avg("_known").alias("_all"))
    table = table.join(F.broadcast(whole))  # one row
    own = lambda c: F.when(F.col("_train"), F.coalesce(c, F.lit(0))).otherwise(0)
    cell = F.try_divide(F.col("_cs") - own(F.col("_ys")), F.col("_cn") - own(F.col("_yn")))
    of_source = F.try_divide(F.col("_ls"), F.col("_ln"))
    reason = (
        F.when(cell.isNotNull() & F.col("_train"), "cell_training_mean_leave_one_year_out")
        .when(cell.isNotNull(), "cell_training_mean")
        .when(of_source.isNotNull(), "label_source_training_mean")
        .otherwise("global_training_mean")
    )
    return table.select(*rows.columns, F.coalesce(cell, of_source, "_all").alias("prediction"), reason.alias("reason"))
