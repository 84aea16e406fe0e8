"""Superlatives, comparisons and aggregate scans over numeric facts; chart read-off by a line fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(numeric: DataFrame, subject: str = "subject_id") -> DataFrame:
    """subject, value: the most reliable number of each subject, the larger one on ties."""
    return numeric.groupBy(subject).agg(F.max(F.struct("reliability", "value_number")).alias("m")).select(subject, F.col("m.value_number").alias("value"))


def superlative(values: DataFrame, k: int = 1, least: bool = False, subject: str = "subject_id") -> DataFrame:
    return values.orderBy(F.asc("value") if least else F.desc("value"), subject).limit(k)


def comparison(values: DataFrame, group: str, subject: str = "subject_id") -> DataFrame:
    """Per group the two largest and their gap."""
    order = Window.partitionBy(group).orderBy(F.desc("value"), subject)
    two = values.withColumns({"rank": F.row_number().over(order)}).filter("rank <= 2")
    return two.groupBy(group).agg(F.max_by(subject, "value").alias("first"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n")).filter("n = 2").select(group, "first", "high", "low", (F.col("high") - F.col("low")).alias("gap"))


def line_fit(bars: DataFrame, near: float = 12.0, tilt: float = 0.06) -> DataFrame:
    """figure_id, slope, intercept, inliers: the line length = slope * printed + intercept that most reference bars agree on.

    Every pair of a figure's references proposes a line; a figure has a few bars, so pairs stay inside a figure.
    """
    refs = bars.filter("printed > 0").select("figure_id", "length", "printed")
    a, b = refs.select("figure_id", F.col("length").alias("la"), F.col("printed").alias("pa")), refs.select("figure_id", F.col("length").alias("lb"), F.col("printed").alias("pb"))
    longest = bars.groupBy("figure_id").agg(F.max("length").alias("longest"))
    lines = a.join(b, "figure_id").filter("pa < pb").withColumn("slope", F.try_divide(F.col("lb") - F.col("la"), F.col("pb") - F.col("pa"))).withColumn("intercept", F.col("la") - F.col("slope") * F.col("pa"))
    lines = lines.join(longest, "figure_id").filter((F.col("slope") > 0) & (F.abs("intercept") <= tilt * F.col("longest")))
    votes = lines.join(refs, "figure_id").withColumn("ok", F.abs(F.col("length") - (F.col("slope") * F.col("printed") + F.col("intercept"))) <= near)
    counted = votes.groupBy("figure_id", "slope", "intercept", "pa", "pb").agg(F.count_if("ok").alias("inliers")).filter("inliers >= 2")
    order = Window.partitionBy("figure_id").orderBy(F.desc("inliers"), F.abs("intercept"), "pa", "pb")
    return counted.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("figure_id", "slope", "intercept", "inliers")


def read_off(length: Column, printed: Column, slope: Column, intercept: Column) -> Column:
    """A struct (value, confidence) of a bar under a fitted line; null where nothing can be told."""
    predicted = (length - intercept) / slope
    agrees = F.abs(printed - predicted) <= F.greatest(F.lit(0.5), 0.03 * F.abs(predicted))
    small = (predicted < 100) & (F.abs(predicted - F.round(predicted)) <= 0.2)
    value = lambda v, c: F.struct(v.cast("double").alias("value"), F.lit(c).alias("confidence"))
    return F.when(agrees, value(printed, 0.93)).when(small, value(F.round(predicted), 0.78))
