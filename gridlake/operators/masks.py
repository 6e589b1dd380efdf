"""The domain mask: rules over depth and elevation, coverage, and what is applied to predictions and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify
from gridlake.operators import splits

# Codes of the mask's reasons.
MISSING, COAST, LAND, DEEP = "qa_missing_crm", "retained_ambiguous_coast", "dropped_definite_land", "dropped_deep_water"


def domain_mask(elevation: Column, depth: Column, status: Column, max_depth: float = 100.0, land: float = 5.0, coast: tuple[float, float] = (-5.0, 5.0), shallow: float = 40.0) -> dict[str, Column]:
    """reason, plausible, depth_bin and elevation_bin of a cell. Cells without a valid value are retained for inspection."""
    label = classify.depth_label
    valid = F.coalesce((status == "valid") & classify.known(elevation) & classify.known(depth), F.lit(False))
    near = valid & elevation.between(*coast)
    high = valid & ~near & (elevation > land)
    sea = valid & ~near & ~high
    deep = sea & (depth > max_depth)
    return {
        "reason": classify.chain([(near, COAST), (high, LAND), (deep, DEEP), (sea, f"retained_depth_0_{label(max_depth)}m")], MISSING),
        "plausible": ~(high | deep),
        "depth_bin": classify.chain([(near, "ambiguous_coast"), (high, "land_positive"), (sea & (depth <= shallow), f"0_{label(shallow)}m"), (deep, f"{label(max_depth)}m_plus"), (sea, f"{label(shallow)}_{label(max_depth)}m")], MISSING),
        "elevation_bin": classify.chain([(near, "ambiguous_coast"), (high, "definite_land"), (sea & (elevation <= coast[0]), "subtidal_ocean"), (sea & (elevation < land) & (elevation > coast[1]), "low_positive_elevation")], MISSING),
    }


def lookup(mask: DataFrame, key: str) -> DataFrame:
    """mask with one row per key; a key that occurs twice stops the job that reads it."""
    others = [c for c in mask.columns if c != key]
    found = mask.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    refused = F.raise_error(F.concat(F.lit(f"two mask rows of one {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.select(F.when(F.col("_n") > 1, refused.cast(mask.schema[key].dataType)).otherwise(F.col(key)).alias(key), *others)


def apply_mask(rows: DataFrame, mask: DataFrame, key: str, plausible: str = "plausible", drop: bool = True) -> DataFrame:
    """rows with the mask's columns, those outside the domain dropped or kept. A row without a mask row stops the job."""
    mark = lookup(mask, key).withColumn("_known", F.lit(True))
    joined = rows.join(mark, key, "left")
    absent = F.raise_error(F.concat(F.lit(f"no mask row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    inside = F.when(F.col("_known").isNull(), absent).otherwise(F.col(plausible))
    return (joined.where(inside) if drop else joined.withColumn(plausible, inside)).drop("_known")


def coverage(mask: DataFrame) -> DataFrame:
    """Cells by reason, and their share of all."""
    counts = mask.groupBy("reason", "plausible").agg(F.count(F.lit(1)).alias("cells"))
    total = F.broadcast(counts.agg(F.sum("cells").alias("_all")))  # one row
    return counts.join(total).select("reason", "plausible", "cells", F.round(F.col("cells") / F.col("_all"), 6).alias("share"))


def retention(positives: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Positive rows by year and source: how many the mask retains, drops, or does not know."""
    joined = positives.join(lookup(mask, key), key, "left")
    n, kept, lost = F.count(F.lit(1)), F.count_if(F.col("plausible")), F.count_if(~F.col("plausible"))
    return joined.groupBy("year", "source").agg(n.alias("positives"), kept.alias("retained"), lost.alias("dropped"), F.count_if(F.col("plausible").isNull()).alias("mask_missing"), F.round(kept / n, 6).alias("retained_share"))


def depth_summary(mask: DataFrame, positives: DataFrame, key: str) -> DataFrame:
    """Cells and positive rows of each depth bin."""
    hits = positives.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    joined = lookup(mask, key).join(hits, key, "left")
    return joined.groupBy("depth_bin").agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("_hits"), F.lit(0)).alias("positives"), F.count("_hits").alias("cells_with_positives"))


def attach_split(rows: DataFrame, manifest: DataFrame, keys: list[str], year_splits: dict[str, list[int]]) -> DataFrame:
    """rows with split and used from the manifest's row of the same keys; without one, by year, and used. Exact copies in
    the manifest count once, two different rows of one key stop the job. A year of no split has none; splits.attach, which
    this calls, can refuse it and rows that the manifest lacks."""
    given = manifest.select(*keys, "split", "used")
    return splits.attach(rows, given, [keys], year_splits, allow_missing=True, any_year=True).drop("drop_reason")
