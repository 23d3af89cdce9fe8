"""Smoothed densities of period features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.quantiles import numeric_estimates

POINTS = 512


def density(
    frequencies: DataFrame, keys: Sequence[str], points: int = POINTS
) -> DataFrame:
    """``keys, point, density_x, density_y``: Gaussian density on an even grid.

    The bandwidth is 0.9 times the smaller of the deviation and the scaled
    quartile range, times n to the power of -1/5; the grid reaches three
    bandwidths beyond the values. Each value is first shared out between its
    two neighbours on the grid, so the kernel runs over ``points`` masses per
    key and not over the values.
    """
    keys = list(keys)
    quartiles = {"q25": 0.25, "q75": 0.75}
    found = numeric_estimates(frequencies, keys, quartiles)
    narrow = F.least(F.col("sd"), (F.col("q75") - F.col("q25")) / 1.34)
    spread = (
        F.when(narrow > 0, narrow)
        .when(F.col("sd") > 0, F.col("sd"))
        .when(F.abs("max") > 0, F.abs("max"))
        .otherwise(1.0)
    )
    # One row per mode and variable.
    shape = found.select(
        *keys,
        "size",
        "min",
        "max",
        (0.9 * spread * F.pow(F.col("size"), F.lit(-0.2))).alias("width"),
    ).select(
        *keys,
        "size",
        "width",
        (F.col("min") - 3 * F.col("width")).alias("origin"),
        (
            (F.col("max") - F.col("min") + 6 * F.col("width")) / F.lit(points - 1)
        ).alias("step"),
    )
    place = (F.col("value") - F.col("origin")) / F.col("step")
    below = F.least(F.floor("place").cast("int"), F.lit(points - 2))
    share = F.col("place") - F.col("below")
    masses = (
        frequencies.join(F.broadcast(shape), keys)
        .withColumn("place", place)
        .withColumn("below", below)
        .select(
            *keys,
            "size",
            "width",
            "origin",
            "step",
            F.inline(
                F.array(
                    F.struct(
                        F.col("below").alias("at"), (F.col("n") * (1 - share)).alias("mass")
                    ),
                    F.struct(
                        (F.col("below") + 1).alias("at"), (F.col("n") * share).alias("mass")
                    ),
                )
            ),
        )
        .groupBy(*keys, "size", "width", "origin", "step", "at")
        .agg(F.sum("mass").alias("mass"))
    )
    away = (F.col("point") - F.col("at")) * F.col("step") / F.col("width")
    kernel = F.exp(-away * away / 2) / (F.col("width") * math.sqrt(2 * math.pi))
    return (
        masses.withColumn(
            "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
        )
        .groupBy(*keys, "point", "origin", "step")
        .agg(F.sum(F.col("mass") / F.col("size") * kernel).alias("density_y"))
        .select(
            *keys,
            "point",
            (F.col("origin") + F.col("point") * F.col("step")).alias("density_x"),
            "density_y",
        )
    )
