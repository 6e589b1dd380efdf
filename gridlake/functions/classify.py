"""Row-wise classification: bins, splits, outcomes, drop reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first case that holds."""
    out = F.when(*[cases[0][0], F.lit(cases[0][1])])
    for condition, label in cases[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def right_closed_bins(x: Column, edges: list[float], zero: str = "000_zero") -> Column:
    """zero for 0, then (lo, hi] bins, then values above the last edge."""
    cases = [(x == 0, zero)] + [((x > lo) & (x <= hi), f"{i + 1:03d}_{lo:g}_{hi:g}") for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return chain(cases, f"{len(edges):03d}_above_{edges[-1]:g}")


def split_of_year(year: Column, splits: dict[str, list[int]]) -> Column:
    return chain([(year.isin(years), name) for name, years in splits.items()])


def outcome(observed: Column, predicted: Column) -> Column:
    return chain([(observed & predicted, "TP"), (~observed & predicted, "FP"), (observed & ~predicted, "FN")], "TN")


def equal_width_band(x: Column, low: Column, high: Column, n: int) -> Column:
    """0 .. n - 1; a constant column is band 0."""
    return F.when(high > low, F.least(F.lit(n - 1), F.floor((x - low) / (high - low) * n))).otherwise(0).cast("int")


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.concat_ws(";", *[F.when(condition, F.lit(name)) for condition, name in pairs])


def sample_score(key: Column, seed: int) -> Column:
    """A repeatable share in [0, 1) from a key below 2 ** 31: a multiplicative hash modulo a prime."""
    return F.pmod(key * 48271 + seed * 7919, F.lit(2147483647)) / 2147483647.0


def year_score(key: Column, year: Column, seed: int) -> Column:
    """A repeatable share in [0, 1) by key and year: (key * 1103515245 + seed + year * 2654435761) modulo 2 ** 32."""
    whole = F.lit(1 << 32)
    return F.pmod(F.pmod(F.pmod(key, whole) * 1103515245, whole) + seed + year * F.lit(2654435761), whole) / float(1 << 32)


def known(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def upper_bins(x: Column, edges: list[tuple[float, str]], above: str, missing: str = "missing", closed: bool = True) -> Column:
    """The label of the first edge that x does not exceed (closed: x <= edge, else x < edge); above beyond the last."""
    return chain([(~known(x), missing), *[((x <= edge) if closed else (x < edge), label) for edge, label in edges]], above)


# Edges and labels of the diagnostic bins.
PROBABILITY_BINS = [(0.10, "[0, .1)"), (0.25, "[.1, .25)"), (0.50, "[.25, .5)"), (0.75, "[.5, .75)"), (0.90, "[.75, .9)")]
MARGIN_BINS = [(-0.50, "<-.50"), (-0.25, "[-.50, -.25)"), (-0.10, "[-.25, -.10)"), (0.0, "[-.10, 0)"), (0.10, "[0, .10)"), (0.25, "[.10, .25)"), (0.50, "[.25, .50)")]
RATIO_BINS = [(1.25, "[1, 1.25]"), (2.0, "(1.25, 2]"), (4.0, "(2, 4]")]
DEPTH_BINS = [(0.0, "not_subtidal_or_zero"), (10.0, "(0, 10m]"), (20.0, "(10, 20m]"), (40.0, "(20, 40m]"), (60.0, "(40, 60m]")]
AREA_EDGES = [1.0, 90.0, 225.0, 450.0, 810.0, 900.0]


def probability_bins(p: Column) -> Column:
    return upper_bins(p, PROBABILITY_BINS, "[.9, 1]", closed=False)


def margin_bins(margin: Column) -> Column:
    return upper_bins(margin, MARGIN_BINS, ">=.50", closed=False)


def ratio_bins(ratio: Column) -> Column:
    return upper_bins(ratio, RATIO_BINS, ">4")


def depth_bins(depth: Column) -> Column:
    return upper_bins(depth, DEPTH_BINS, ">60m", missing="missing_depth")


def residual_bins(residual: Column) -> Column:
    return chain([(~known(residual), "missing"), (residual < -450, "<-450"), (residual < -90, "[-450, -90)"), (residual <= 90, "[-90, 90]"), (residual <= 450, "(90, 450]")], ">450")


def area_bins(area: Column, edges: list[float] = AREA_EDGES) -> Column:
    """Zero apart, then (lower, upper]; negative areas fall into the first of these."""
    pairs = [(upper, f"({lower:g}, {upper:g}]") for lower, upper in zip([0.0, *edges[:-1]], edges, strict=True)]
    return F.when(area == 0, "000_zero").otherwise(upper_bins(area, pairs, f">{edges[-1]:g}"))


def threshold_bins(area: Column, threshold: float = 90.0, edges: list[float] = AREA_EDGES) -> Column:
    """Zero, (0, threshold), then [lower, upper) from the threshold on; the last edge has a bin of its own."""
    uppers = [e for e in edges if e > threshold]
    top = uppers[-1] if uppers else threshold
    cases = [(~known(area), "missing"), (area == 0, "0"), (area < threshold, f"(0, {threshold:g})"), (F.abs(area - top) <= 1e-9 * F.greatest(F.abs(area), F.lit(top)), f"{top:g}"), (area > top, f">{top:g}")]
    return chain(cases + [(area < upper, f"[{lower:g}, {upper:g})") for lower, upper in zip([threshold, *uppers[:-1]], uppers, strict=True)], f"[{threshold:g}, {top:g})")


def coast_depth(reason: Column, depth: Column, elevation: Column) -> Column:
    return chain([(reason.contains("ambiguous"), "ambiguous_coast"), (known(depth) & (depth > 0), "subtidal_ocean"), (known(elevation) & (elevation > 0), "landward_or_intertidal")], "missing_depth_context")


def persistence(valid: Column, positive: Column) -> Column:
    """By the number of quarters: all valid ones positive goes before one alone."""
    cases = [(valid.isNull() | (valid == 0), "missing_quarters"), (positive == 0, "no_quarter_present"), (positive == valid, "persistent_all_valid_quarters"), (positive == 1, "transient_one_quarter")]
    return chain(cases, "intermittent_two_or_three_quarters")


def seasonality(valid: Column, positive: Column) -> Column:
    """As persistence, but one quarter alone goes before all valid ones."""
    cases = [(valid.isNull() | (valid == 0), "missing_quarters"), (positive == 0, "no_quarter_present"), (positive == 1, "one_quarter_spike"), (positive == valid, "persistent_all_valid_quarters")]
    return chain(cases, "intermittent_two_or_three_quarters")


def temporal_label(source: Column, season: Column, observed: Column) -> Column:
    renamed = F.create_map(*[F.lit(x) for pair in {"one_quarter_spike": "one_quarter_spike", "intermittent_two_or_three_quarters": "intermittent", "persistent_all_valid_quarters": "persistent"}.items() for x in pair])
    cases = F.when(source == "assumed_background", "assumed_background").when((season == "no_quarter_present") & (observed > 0), "no_quarter_positive")
    return cases.otherwise(F.coalesce(F.try_element_at(renamed, season), season))


def previous_year(previous: Column, current: Column, threshold: float = 90.0) -> Column:
    before, now = previous >= threshold, F.coalesce(current >= threshold, F.lit(False))
    return chain([(~known(previous), "missing_previous_year"), (before & now, "persistent_ge_10pct"), (~before & now, "new_ge_10pct"), (before & ~now, "lost_ge_10pct"), (previous > 0, "previous_low_canopy")], "stable_zero_or_background")


def residual_taxonomy(observed: Column, predicted: Column, residual: Column) -> Column:
    return chain(
        [
            (~known(observed) | ~known(predicted) | ~known(residual), "missing_or_uncalculable"), (F.abs(residual) <= 1.0, "near_correct"),
            ((observed == 0) & (predicted > 0), "observed_zero_false_positive"), ((observed >= 450.0) & (residual > 0), "high_canopy_underprediction"),
            (residual > 0, "positive_underprediction"), (residual < 0, "low_canopy_overprediction"),
        ],
        "near_correct",
    )


def failure_flags(observed: Column, p: Column, conditional: Column, expected: Column, threshold: float, tolerance: float, low: float = 90.0, half: float = 450.0) -> dict[str, Column]:
    """Seven flags of what a two-part prediction gets wrong, in the order in which they name a row's failure class."""
    seen, found = observed >= low, p >= threshold
    return {
        "high_confidence_wrong": ((p >= 0.90) & ~seen) | ((p < 0.10) & seen),
        "support_miss_positive": seen & ~found,
        "support_leakage_zero": (observed == 0) & found,
        "amount_overprediction_low_or_zero": (observed < low) & (expected - observed > tolerance),
        "composition_shrinkage": seen & found & (conditional - expected >= tolerance) & (conditional >= half / 2),
        "amount_underprediction_detected_positive": seen & found & (observed - expected > tolerance),
        "near_correct": F.abs(observed - expected) <= tolerance,
    }


def failure_class(flags: dict[str, Column]) -> Column:
    return chain([(flag, name) for name, flag in flags.items()], "other_residual_or_context_mismatch")


def edge_class(positive: Column, near: Column, wide: Column) -> Column:
    """By the positives in the 3 x 3 (near) and 5 x 5 window (wide), the cell itself included."""
    cases = [(positive & (near <= 1), "isolated_positive"), (positive & (near >= 9), "positive_interior"), (positive, "positive_edge"), (near > 0, "zero_adjacent_to_positive"), (wide > 0, "near_positive_exterior")]
    return chain(cases, "far_zero_exterior")


def exterior_ring(edge: Column) -> Column:
    return chain([(edge.isin("positive_interior", "positive_edge", "isolated_positive"), "observed_positive"), (edge == "zero_adjacent_to_positive", "adjacent_8_neighbor_ring"), (edge == "near_positive_exterior", "near_5x5_ring")], "far_exterior")


def season_of(quarter: Column) -> Column:
    return chain([(quarter == 1, "winter"), (quarter == 2, "spring"), (quarter == 3, "summer"), (quarter == 4, "fall")])


def label_source(columns: list[str]) -> Column:
    """The source named in a row (null: unknown), else by the observed flag, else 'all', as far as the columns go."""
    if "label_source" in columns:
        return F.coalesce("label_source", F.lit("unknown"))
    if "is_observed" in columns:
        return F.when(F.col("is_observed"), "observed").otherwise("assumed_background")
    return F.lit("all")


def cleaned_area(x: Column) -> Column:
    """Fill values (negative areas) and NaN become null."""
    return F.when(known(x) & (x >= 0), x)


def without_nodata(x: Column, nodata: list[float]) -> Column:
    """x, null where it is, but for rounding, one of the nodata values."""
    near = [F.abs(x - v) <= 1e-8 + 1e-5 * abs(v) for v in nodata]
    return F.when(known(x) & ~(F.greatest(*near, F.lit(False)) if near else F.lit(False)), x)


def clipped_area(fraction: Column, cell_area: float = 900.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * cell_area


def complete(*features: str) -> Column:
    """All features are known numbers."""
    out = F.lit(True)
    for f in features:
        out &= known(F.col(f))
    return out


def present(fraction: Column, threshold: float) -> Column:
    """fraction >= threshold; a threshold of 0 asks for more than nothing."""
    return fraction > 0 if threshold == 0 else fraction >= threshold


def boolish(x: Column) -> Column:
    """Booleans from what tables hold as text or numbers; null where it is neither."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin("true", "t", "yes", "y", "1", "1.0"), True).when(s.isin("false", "f", "no", "n", "0", "0.0"), False)


def checked_split(year: Column, splits: dict[str, list[int]]) -> Column:
    """split_of_year; years in two splits are refused at once, a year in none when its row is met."""
    years = [y for found in splits.values() for y in found]
    if len(years) != len(set(years)):
        raise ValueError(f"a year is in two splits: {sorted(y for y in set(years) if years.count(y) > 1)}")
    return F.coalesce(split_of_year(year, splits), F.raise_error(F.concat(F.lit("no split for year "), F.coalesce(year.cast("string"), F.lit("null")))))


def bands(spec: str | list[str]) -> list[str]:
    """Column names of 'A00-A63', 'A00,A05' or a list."""
    if not isinstance(spec, str):
        return list(spec)
    out = []
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        if last:
            head, width = first.rstrip("0123456789"), len(first) - len(first.rstrip("0123456789"))
            out += [f"{head}{i:0{width}d}" for i in range(int(first[len(head) :]), int(last[len(head) :]) + 1)]
        else:
            out.append(first)
    return out


def depth_label(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value).replace(".", "p")


def feature_label_group(area: Column, full: float = 900.0) -> Column:
    return chain([(area == 0, "zero"), (area >= full, "saturated_900"), (area >= 450, "high_canopy")], "positive_low_mid")


# Context columns that a layer has, and what stands there where its table has none.
CONTEXT_DEFAULTS = {"label_source": "unknown", "is_observed": False, "reason": "unknown", "depth_bin": "unknown", "mask_status": "unknown", "evaluation_scope": "unknown"}


def context_columns(columns: list[str], named: dict[str, str]) -> dict[str, Column]:
    """The context columns that a table with these columns lacks, by default values, and constant ones from named."""
    return {c: F.lit(v) for c, v in CONTEXT_DEFAULTS.items() if c not in columns} | {c: F.lit(v) for c, v in named.items()}
