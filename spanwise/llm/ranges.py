"""Buckets of consecutive ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a ``bucket`` that rises with the long column ``key``; equal keys share one, null has -1.

    The bounds are quantiles of the keys alone, as many as there are shuffle partitions.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(key).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    bounds = F.array(*[F.lit(int(b)) for b in sorted(set(found))]).cast("array<long>")
    place = F.size(F.filter(bounds, lambda b: b < F.col(key)))
    return rows.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(place))
