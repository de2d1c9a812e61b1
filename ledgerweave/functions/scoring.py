"""Column expressions for robust z values, scores, levels and reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
WEIGHT_DISTINCT = 0.4
WEIGHT_OUT_HH = 0.4
WEIGHT_DENSITY = 0.2
MED_THRESHOLD = 2.0
HIGH_THRESHOLD = 3.0
REASON_THRESHOLD = 2.0
MAD_FACTOR = 1.4826
MIN_SCALE = 1e-9
HISTORY_DEPTH = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_median(values: Column) -> Column:
    """The middle element of the sorted array; the later one if the size is even."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def robust_z(x: Column, history: Column) -> Column:
    """Distance of ``x`` from the median of ``history`` in scaled MADs; 0 without history."""

    def against(median: Column) -> Column:
        mad = upper_median(F.transform(history, lambda v: F.abs(v - median)))
        return (x - median) / F.greatest(MAD_FACTOR * mad, F.lit(MIN_SCALE))

    return F.when(F.size(history) > 0, _let(upper_median(history), against)).otherwise(F.lit(0.0))


def score(z_distinct: Column, z_out_hh: Column, z_density: Column) -> Column:
    return WEIGHT_DISTINCT * z_distinct + WEIGHT_OUT_HH * z_out_hh + WEIGHT_DENSITY * z_density


def level(s: Column, med: float = MED_THRESHOLD, high: float = HIGH_THRESHOLD) -> Column:
    return F.when(s >= high, "HIGH").when(s >= med, "MED").otherwise("LOW")


def level_marker(level_name: Column) -> Column:
    """Traffic-light word for a level."""
    return (
        F.when(level_name == "HIGH", "red")
        .when(level_name == "MED", "orange")
        .when(level_name == "LOW", "green")
        .otherwise("none")
    )


def reason(z_distinct: Column, z_out_hh: Column, z_density: Column) -> Column:
    """One line that names the figures at or above the reason threshold."""
    grown = z_distinct >= REASON_THRESHOLD
    concentrated = z_out_hh >= REASON_THRESHOLD
    dense = z_density >= REASON_THRESHOLD
    named = F.concat_ws(
        " + ",
        F.when(grown, "group growth"),
        F.when(concentrated, "outflow concentration"),
        F.when(dense, "dense group"),
    )
    return (
        F.when(grown & concentrated & dense, "growth + concentration + density (highly suspicious)")
        .when(named == "", "steady")
        .otherwise(named)
    )


def density(edges: Column, accounts: Column) -> Column:
    """Undirected density 2E / (N (N - 1)); 0 for fewer than two accounts."""
    n = accounts.cast("double")
    return F.when(accounts < 2, F.lit(0.0)).otherwise(2.0 * edges.cast("double") / (n * (n - 1)))


#: Weights are cut to integers up to here, where doubles are exact.
LARGEST_WEIGHT = 2**53


def sound(amount: Column) -> Column:
    """The amount as double; what is no finite number counts as 0."""
    value = amount.cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(0.0))


def flow_weight(amount: Column) -> Column:
    """Transfer strength: the amount, but at least 1."""
    return F.greatest(F.lit(1.0), sound(amount))


def whole_weight(amount: Column) -> Column:
    """Flow weight cut to an integer, as added to sketches; at most ``LARGEST_WEIGHT``."""
    return F.least(flow_weight(amount), F.lit(float(LARGEST_WEIGHT))).cast("long")
