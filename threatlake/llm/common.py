"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatlake.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# The ASCII white space of the contracts: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared scratch folder and read from there.

    Cuts the lineage: a lost executor costs a new read, not the steps before.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it a column that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SLICE_ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as a worker need not hold ten thousand long texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker process keeps for its next tasks: one thing at a time.

    Workers are used again by later stages, and what an earlier stage kept would stay in memory
    beside what the next one needs.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and no other letter; the plain function does that where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Runs of characters outside the class ``separators``; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{separators}+", -1)
    return F.filter(parts, lambda w: w != "")


# Squared distances of up to 64 components stay below 2^62 within this.
LARGEST_COMPONENT = 2**26


def finite_vector(vector: Column) -> Column:
    """Whether there is a vector and every component is a number."""
    limit = F.lit(float("inf"))
    each = F.forall(vector, lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(each, F.lit(False))


def scaled_integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; too large ones end the job, as distances could overflow."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        error = F.raise_error(F.lit("a component is too large for exact distances"))
        return F.when(F.abs(scaled) <= LARGEST_COMPONENT, F.floor(scaled)).otherwise(error)

    return F.transform(vector, whole)
