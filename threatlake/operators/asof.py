"""The latest version of a key at a time, as a scan over time-ordered slices.

Events and versions are put in one timeline, cut into ranges of (key, time).  A hot key, or a hot
hour of one key, is thus as many ranges as its rows need; rows of the very same instant are told
apart by a hash.  Every range carries the last version forward by itself and says at its end which
version it leaves behind.  Only the events before the first version of a range's first key look
further back: they take what the ranges before left, one row per range.

The ranges are written between the two steps, because a range that is computed anew may be cut at
other places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from threatlake.session import written


def as_of(
    events: DataFrame,
    history: DataFrame,
    key: str,
    time_col: str,
    version_cols: list[str],
    order_col: str,
) -> DataFrame:
    """Events, each with the latest version of its key no later than the event.

    Versions of the same instant are ordered by ``order_col``.  Events without a version, without a
    key or without a time keep their row, with null version columns; versions without a key or a
    time are never found.  Repeated events are rows of their own.
    """
    none = F.lit(None)
    # Versions come before events of the same instant.
    versions = history.where(F.col(key).isNotNull() & F.col(time_col).isNotNull()).select(
        F.col(key).alias("_key"),
        F.struct(
            F.col(time_col).alias("time"), F.lit(0).alias("kind"), F.col(order_col).cast("bigint").alias("n")
        ).alias("_at"),
        F.struct(*version_cols).alias("_version"),
    )
    # No version can be found without a time, so such an event is asked before all times.
    asked = events.select(
        F.col(key).alias("_key"),
        F.struct(
            F.col(time_col).alias("time"), F.lit(1).alias("kind"), F.xxhash64(*events.columns).alias("n")
        ).alias("_at"),
        F.struct(*events.columns).alias("_event"),
    )
    timeline = versions.withColumn("_event", none).unionByName(asked.withColumn("_version", none))
    ranges = timeline.repartitionByRange("_key", "_at").sortWithinPartitions("_key", "_at")
    ordered = ranges.select(F.spark_partition_id().alias("_range"), "_key", "_version", "_event")
    out = StructType([StructField(f.name, f.dataType) for f in ordered.schema]).add("_open", BooleanType())
    filled = written(ordered.mapInArrow(_carried_forward, out), "as-of")

    left = filled.where(F.col("_event").isNull())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = left.select(
        "_range",
        F.last(F.when(F.col("_version").isNotNull(), F.struct("_key", "_version")), True).over(before).alias("_carry"),
    ).where(F.col("_carry").isNotNull())
    # One row per range.
    rows = filled.where(F.col("_event").isNotNull()).join(F.broadcast(carry), "_range", "left")
    reaches = F.col("_open") & (F.col("_key") == F.col("_carry._key"))
    version = F.when(reaches, F.col("_carry._version")).otherwise(F.col("_version")).alias("_found")
    return rows.select("_event", version).select("_event.*", "_found.*")


def _carried_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of one sorted range with the last version before them, and the range's last version.

    ``_open`` marks events of the first key that no version of the range comes before.
    """
    first = key = number = None
    version = None  # the last version of all, as an array of one
    version_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges, keys, versions, events = batch.columns
        n = batch.num_rows
        if number is None:
            number, first = ranges.slice(0, 1), keys.slice(0, 1)
        if version is None:
            version = pa.nulls(1, versions.type)
        starts = np.ones(n, bool)
        starts[1:] = ~_same(keys.slice(1), keys.slice(0, n - 1))
        starts[0] = key is None or not _same(keys.slice(0, 1), key)[0]
        known = versions.is_valid().to_numpy(zero_copy_only=False)
        at = np.arange(n)
        latest = np.maximum.accumulate(np.where(known, at, -1))
        begin = np.maximum.accumulate(np.where(starts, at, -1))
        # Place 0 is the version that earlier batches left, for the key they ended with.
        goes_on = version_key is not None and bool(_same(keys.slice(0, 1), version_key)[0])
        through = (begin < 0) & (latest < 0) & goes_on
        found = np.where((latest >= 0) & (latest >= begin), latest + 1, np.where(through, 0, -1))
        asked = np.flatnonzero(events.is_valid().to_numpy(zero_copy_only=False))
        places = pa.array(found[asked], mask=found[asked] < 0)
        is_first = _same(keys, first.take(pa.array(np.zeros(n, np.int64))))
        yield pa.record_batch(
            [
                ranges.take(pa.array(asked)),
                keys.take(pa.array(asked)),
                pa.concat_arrays([version, versions]).take(places),
                events.take(pa.array(asked)),
                pa.array((found < 0)[asked] & is_first[asked]),
            ],
            ["_range", "_key", "_version", "_event", "_open"],
        )
        key = keys.slice(n - 1)
        if latest[-1] >= 0:
            version, version_key = versions.slice(latest[-1], 1), keys.slice(latest[-1], 1)
    if number is not None:
        last = first if version_key is None else version_key
        yield pa.record_batch(
            [number, last, version, pa.nulls(1, events.type), pa.array([False])],
            ["_range", "_key", "_version", "_event", "_open"],
        )


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether two arrays of keys agree, place by place; a missing key agrees with none."""
    return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
