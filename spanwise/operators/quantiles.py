"""Exact quantiles of many groups without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per e-fold of the values, and the value where the scale turns linear.
FINENESS = 4096
LINEAR_BELOW = 1e-6


def _bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises (logarithmic scale)."""
    size = F.log1p(F.abs(value) / F.lit(LINEAR_BELOW))
    return F.floor(F.signum(value) * size * F.lit(FINENESS))


def _centre(bucket: Column) -> Column:
    """The value at which a bucket begins."""
    size = F.expm1(F.abs(bucket) / F.lit(FINENESS)) * F.lit(LINEAR_BELOW)
    return F.signum(bucket) * size


def numeric_estimates(
    frequencies: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """``keys, size, min, max, mean, sd`` and one column per quantile name.

    ``frequencies`` holds ``keys, value, n`` with each value once per key and
    no NULLs. Quantiles interpolate linearly between neighbours. The values are
    summed up per bucket of nearby values; the number of buckets is bounded by
    the scale, so the bucket of each wanted rank is found on that small table.
    Only the values of these buckets are put in order.
    """
    keys = list(keys)
    placed = frequencies.withColumn("bucket", _bucket(F.col("value")))
    # One row per key, joined by the key alone, and the look-up never NULL: a
    # condition on the bucket would be pushed below the frequencies, and they
    # would be computed once with it and once without.
    before = F.coalesce(F.try_element_at("wanted", F.col("bucket")), F.lit(-1))
    shapes = F.broadcast(_shapes(placed, keys, quantiles))
    within = (
        Window.partitionBy(*keys, "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ordered = (
        placed.join(shapes, keys)
        .withColumn("before", before)
        .filter(F.col("before") >= 0)
        .withColumn("last", F.col("before") + F.sum("n").over(within))
    )

    def value_at(rank):
        held = (rank >= F.col("last") - F.col("n")) & (rank < F.col("last"))
        return F.max(F.when(held, F.col("value")))

    moments = ("size", "min", "max", "mean", "sd")
    found = ordered.groupBy(*keys).agg(
        *[F.first(f"shape.{m}").alias(m) for m in moments],
        *[
            value_at(side(_position(q, F.col("shape.size")))).alias(f"{name}_{label}")
            for name, q in quantiles.items()
            for label, side in (("low", F.floor), ("high", F.ceil))
        ],
    )
    return found.select(*keys, *moments, *[_between(n, q) for n, q in quantiles.items()])


def _position(q: float, size: Column) -> Column:
    """Place of a quantile among ``size`` ordered values, counted from 0."""
    return F.lit(float(q)) * (size - 1)


def _between(name: str, q: float) -> Column:
    low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
    place = _position(q, F.col("size"))
    return (low + (high - low) * (place - F.floor(place))).alias(name)


def _shapes(
    placed: DataFrame, keys: list[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """``keys, shape, wanted``: the moments, and the buckets that hold a rank.

    ``wanted`` maps such a bucket, at most two per quantile, to the number of
    values before it. Squares are taken around the bucket's own place first, as
    plain sums of squares lose digits when the mean is far from zero.
    """
    offset = F.col("value") - F.col("centre")
    buckets = (
        placed.withColumn("centre", _centre(F.col("bucket")))
        .groupBy(*keys, "bucket", "centre")
        .agg(
            F.sum("n").alias("held"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.sum(F.col("n") * offset).alias("shift"),
            F.sum(F.col("n") * offset * offset).alias("square"),
        )
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    held, size = F.col("held"), F.col("size")
    weighted = held * F.col("centre") + F.col("shift")
    summed = (
        buckets.withColumn("reached", F.sum("held").over(upto))
        .withColumn("size", F.sum("held").over(group))
        .withColumn("mean", F.sum(weighted).over(group) / F.col("size"))
        .withColumn("before", F.col("reached") - held)
    )
    away = F.col("centre") - F.col("mean")
    squares = F.sum(F.col("square") + 2 * away * F.col("shift") + held * away * away)
    freedom = F.first("size") - 1
    spread = F.sqrt(F.greatest(squares, F.lit(0.0)) / freedom)
    ranks = [
        side(_position(q, size)) for q in quantiles.values() for side in (F.floor, F.ceil)
    ]
    holds = F.lit(False)
    for rank in ranks:
        holds = holds | ((rank >= F.col("before")) & (rank < F.col("reached")))
    entry = F.when(holds, F.struct("bucket", "before"))
    return summed.groupBy(*keys).agg(
        F.struct(
            F.first("size").alias("size"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.first("mean").alias("mean"),
            F.when(freedom > 0, spread).alias("sd"),
        ).alias("shape"),
        F.map_from_entries(F.collect_list(entry)).alias("wanted"),
    )
