"""Exact "first k rows" of very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_HEX_DIGITS = 4


def hash_order(key: Column) -> Column:
    """A fixed, evenly spread order of rows."""
    return F.md5(key.cast("string"))


def mark_first(
    df: DataFrame, key: str, groups: list[str], take: Column, into: str, value: str | None = None
) -> DataFrame:
    """Flag the first ``take`` rows of every group in hash order of the unique ``key``.

    Groups are few, such as the classes of a label: the last chosen row of each is broadcast.

    ``take`` may use ``total`` (rows of the group) and ``lo``/``hi`` (least and greatest
    ``value``).  A row number over a group would sort the group in one task; instead the rows are
    counted per group and hash prefix (at most 65,536 counts per group), the prefix that holds the
    last chosen row is found, and only its rows are ranked.  The flag itself is a comparison with
    that row.
    """
    digest = hash_order(F.col(key))
    bucket = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("int")
    keyed = df.select(key, *groups, digest.alias("_h"), bucket.alias("_b"))
    bounds = F.col(value) if value else F.lit(0)
    counts = (
        df.select(*groups, bucket.alias("_b"), bounds.alias("_v"))
        .groupBy(*groups, "_b")
        .agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    )
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.select(
            *groups,
            "_b",
            "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
            F.sum("n").over(whole).alias("total"),
            F.min("lo").over(whole).alias("lo"),
            F.max("hi").over(whole).alias("hi"),
        )
        .withColumn("need", take - F.col("before"))
        .where((F.col("need") > 0) & (F.col("need") <= F.col("n")))
        .select(*groups, "_b", "need")
    )
    in_group = Window.partitionBy(*groups).orderBy("_h", key)
    last = (
        keyed.join(cut, [*groups, "_b"])
        .withColumn("_rank", F.row_number().over(in_group))
        .where(F.col("_rank") == F.col("need"))
        .select(*groups, F.struct("_h", key).alias("_last"))
    )
    place = F.struct(digest.alias("_h"), F.col(key).alias(key))
    if groups:
        # One row per group, which the aggregation says even where the estimate does not.
        ends = last.groupBy(*groups).agg(F.max("_last").alias("_last"))
        flagged = df.join(F.broadcast(ends), groups, "left")
    else:
        flagged = df.withColumn("_last", last.select("_last").scalar())
    return flagged.withColumn(into, F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_last")
