"""Tables of measures over many contexts at once: a family of groupings below fixed keys, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import classify


def families(rows: DataFrame, base: list[str], contexts: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """base, context_type, context_value and the measures of each value of each context, below each of the base keys.

    One grouping set for each context: rows are summed within tasks by every set before they are shuffled, so what moves
    is groups and not rows. A null context value is the value 'missing'; null base keys are keys like others.
    """
    named = {f"_c{i}": F.coalesce(c.cast("string"), F.lit("missing")) for i, c in enumerate(contexts.values())}
    table = rows.withColumns(named)
    sets = [[*base, c] for c in named]
    found = table.groupingSets(sets, *base, *named).agg(*[m.alias(n) for n, m in measures.items()])
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(named, contexts, strict=True)])
    return found.select(*base, kind.alias("context_type"), F.coalesce(*named).alias("context_value"), *measures)


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def support_measures(observed: Column, predicted: Column, probability: Column, threshold: float) -> dict[str, Column]:
    """How a yes-or-no prediction meets what was observed."""
    n, seen, said = F.count(F.lit(1)), F.count_if(observed), F.count_if(predicted)
    tp, fp, fn = F.count_if(observed & predicted), F.count_if(~observed & predicted), F.count_if(observed & ~predicted)
    precision, recall = rate(tp, said), rate(tp, seen)
    return {
        "row_count": n,
        "observed_positive_count": seen,
        "observed_positive_rate": rate(seen, n),
        "predicted_positive_count": said,
        "predicted_positive_rate": rate(said, n),
        "precision": precision,
        "recall": recall,
        "f1": rate(2 * precision * recall, precision + recall),
        "true_positive_count": tp,
        "false_positive_count": fp,
        "false_positive_rate": rate(fp, n - seen),
        "false_negative_count": fn,
        "false_negative_rate": rate(fn, seen),
        "true_negative_count": n - seen - fp,
        "probability_mean": F.avg(probability),
        "threshold_margin_mean": F.avg(probability - threshold),
    }


def amount_measures(observed: Column, amounts: dict[str, Column]) -> dict[str, Column]:
    """Observed and predicted amounts, and for each prediction its bias and errors."""
    total = F.sum(observed)
    out = {"observed_area": total}
    for name, amount in amounts.items():
        error = observed - amount
        out |= {
            f"{name}_area": F.sum(amount),
            f"{name}_area_bias": F.sum(amount) - total,
            f"{name}_percent_bias": 100 * rate(F.sum(amount) - total, total),
            f"{name}_mean_residual": F.avg(error),
            f"{name}_mae": F.avg(F.abs(error)),
            f"{name}_rmse": F.sqrt(F.avg(error * error)),
        }
    return out


def failure_measures(flags: dict[str, tuple[str, Column]], wholes: dict[str, Column]) -> dict[str, Column]:
    """For each flag (a name, and the whole it is a share of) its rows and their rate."""
    out = {}
    for name, (whole, flag) in flags.items():
        out |= {f"{name}_count": F.count_if(flag), f"{name}_rate": rate(F.count_if(flag), wholes[whole])}
    return out


def windows(cells: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """cells (keys, row, col and others) with <flag>_3x3 and <flag>_5x5: how many cells around each, itself included, have
    a flag. Cells are sent to the cells of their windows and summed there; nothing is joined. Repeated cells are refused."""
    reach = range(-2, 3)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach]))
    own = F.struct(*[c for c in cells.columns if c not in (*keys, "row", "col")])
    sent = cells.select(*keys, "row", "col", own.alias("_own"), *[F.col(f).cast("int").alias(f"_{f}") for f in flags], steps.alias("_s"))
    i, j = F.col("_s.i"), F.col("_s.j")
    here, near = (i == 0) & (j == 0), (F.abs(i) <= 1) & (F.abs(j) <= 1)
    at = [*[F.col(k) for k in keys], (F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")]
    counts = [c for f in flags for c in (F.sum(F.when(near, F.col(f"_{f}")).otherwise(0)).alias(f"{f}_3x3"), F.sum(f"_{f}").alias(f"{f}_5x5"))]
    summed = sent.groupBy(*at).agg(F.max_by("_own", here.cast("int")).alias("_own"), F.count_if(here).alias("_here"), *counts).where("_here > 0")
    once = F.when(F.col("_here") > 1, F.raise_error(F.lit("a cell occurs twice")).cast("boolean")).otherwise(True)
    return summed.where(once).select(*keys, "row", "col", "_own.*", *[f"{f}_{size}" for f in flags for size in ("3x3", "5x5")])


def edge_measures(observed: Column, predicted: Column, wrong: Column, shrunk: Column, residuals: dict[str, Column]) -> dict[str, Column]:
    """Where false positives, misses and shrinkage stand against the edges of what was observed and of what was predicted.

    The rows have observed_3x3, observed_5x5 and predicted_3x3 of windows(). wrong: predictions wrong with confidence;
    shrunk: amounts lost by composition.
    """
    edge = classify.edge_class(observed, F.col("observed_3x3"), F.col("observed_5x5"))
    fp, fn = ~observed & predicted, observed & ~predicted
    adjacent, near = edge == "zero_adjacent_to_positive", edge == "near_positive_exterior"
    alone, rim, inner = edge == "isolated_positive", edge == "positive_edge", edge == "positive_interior"
    around = F.col("predicted_3x3")
    out = {
        "row_count": F.count(F.lit(1)),
        "observed_positive_count": F.count_if(observed),
        "false_positive_count": F.count_if(fp),
        "false_negative_count": F.count_if(fn),
    }
    shares = {
        "fp_isolated_predicted_positive": (fp, around <= 1),
        "fp_predicted_edge": (fp, (around > 1) & (around < 9)),
        "fp_predicted_interior": (fp, around >= 9),
        "fp_adjacent_observed": (fp, adjacent),
        "fp_near_observed": (fp, near),
        "fp_far_from_observed": (fp, ~(adjacent | near)),
        "fp_adjacent_or_near_positive": (fp, adjacent | near),
        "fn_isolated_positive": (fn, alone),
        "fn_positive_edge": (fn, rim),
        "fn_positive_edge_or_isolated": (fn, alone | rim),
        "fn_positive_interior": (fn, inner),
        "composition_shrinkage_edge": (alone | rim, shrunk),
    }
    for name, (whole, part) in shares.items():
        out |= {f"{name}_count": F.count_if(whole & part), f"{name}_rate": rate(F.count_if(whole & part), F.count_if(whole))}
    out |= {
        "high_confidence_fp_adjacent_or_near_count": F.count_if(fp & (adjacent | near) & wrong),
        "high_confidence_fn_edge_or_isolated_count": F.count_if(fn & (alone | rim) & wrong),
    }
    for name, residual in residuals.items():
        out |= {f"{name}_positive_edge_mean_residual": F.avg(F.when(alone | rim, residual)), f"{name}_positive_interior_mean_residual": F.avg(F.when(inner, residual))}
    return out
