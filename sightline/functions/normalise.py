"""Heatmap normalisation: whole-column statistics in one row, then a narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("unit", "exponential", "welford")


def _with(df: DataFrame, **stats) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in stats.items()])))  # one row


def unit(df: DataFrame, value: str = "value") -> DataFrame:
    """(x - min) / (max - min); 0 where all values are equal."""
    v = F.col(value).cast("double")
    span = F.col("high") - F.col("low")
    return _with(df, low=F.min(v), high=F.max(v)).withColumn("normal", F.when(span != 0, (v - F.col("low")) / span).otherwise(0.0)).drop("low", "high")


def exponential(df: DataFrame, value: str = "value") -> DataFrame:
    """The square root of x / max; 0 where the maximum is 0."""
    v = F.col(value).cast("double")
    return _with(df, high=F.max(v)).withColumn("normal", F.when(F.col("high") != 0, F.sqrt(v / F.col("high"))).otherwise(0.0)).drop("high")


def welford(df: DataFrame, value: str = "value", epsilon: float = 1.1920929e-07) -> DataFrame:
    """Standard scores stretched to 0..1, then moved twice so that their mean comes to one half, clamped each time."""
    v = F.col(value).cast("double")
    scored = _with(df, mean=F.avg(v), sigma=F.stddev_pop(v))
    scored = scored.withColumn("normal", (v - F.col("mean")) / F.greatest(F.col("sigma"), F.lit(epsilon))).drop("mean", "sigma")
    stretched = unit(scored, "normal")

    def moved(rows: DataFrame) -> DataFrame:
        shift = F.when(F.abs(F.col("mean") - 0.5) > epsilon, 0.5 - F.col("mean")).otherwise(0.0)
        return _with(rows, mean=F.avg("normal")).withColumn("normal", F.least(F.greatest(F.col("normal") + shift, F.lit(0.0)), F.lit(1.0))).drop("mean")

    return moved(moved(stretched))


def normalise(df: DataFrame, method: str, value: str = "value") -> DataFrame:
    """Add `normal`, the value on a scale of 0 to 1, by one of METHODS."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return {"unit": unit, "exponential": exponential, "welford": welford}[method](df, value)


def pixel(normal):
    """An 8-bit grey: the product with 255 cut off, saturated; 0 for no number."""
    clean = F.when(F.isnan(normal) | normal.isNull(), 0.0).otherwise(normal)
    return F.least(F.greatest(F.floor(clean * 255), F.lit(0)), F.lit(255)).cast("int")
