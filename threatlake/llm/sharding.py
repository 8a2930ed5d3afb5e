"""Shards by jump consistent hashing, with gapless places inside each shard.

The shard of a row depends on its key and the number of shards alone.  With one shard more, a key
either stays or goes to the new shard; no ring table is kept.  Only columns are used: the hash is
a digest of the key, the jumps are a fold over at most as many steps as there are shards.

Empty tables give no rows.  A null key counts as the empty string.  Rows that share a key share a
shard; their places follow the other columns of the order.  Column names that start with ``_``
are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 4096

_TWO64 = 2**64
# Multiplier of the published jump hash, and the 31 bits that a jump takes.
_MULTIPLIER = 2862933555777941757
_BITS31 = 2**31


def key_hash(key: Column) -> Column:
    """A key's stable hash, 0 to 2^64 - 1."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump(hash_column: str, shards: int) -> Column:
    """Shard, 0 to ``shards`` - 1, of a 64-bit hash."""
    following = f"cast((s.k * {_MULTIPLIER} + 1) % {_TWO64} as decimal(20,0))"
    step = (
        "named_struct('b', s.j, "
        f"'j', cast(floor((s.j + 1) * ({_BITS31}D / (cast(n div {2**33} as bigint) + 1))) as bigint), "
        "'k', n)"
    )
    return F.expr(
        f"cast(aggregate(sequence(1, {int(shards)}), "
        f"named_struct('b', -1L, 'j', 0L, 'k', {hash_column}), "
        f"(s, i) -> if(s.j < {int(shards)}, transform(array({following}), n -> {step})[0], s), "
        "s -> s.b) as int)"
    )


def assign(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard if there were one more."""
    hashed = rows.withColumn("_hash", key_hash(F.col(key)))
    return hashed.withColumns(
        {"shard": jump("_hash", shards), "grown_shard": jump("_hash", shards + 1)}
    )


def place(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Add ``slot``: places in hash order, then ``order``, gapless from 0 in each shard.

    A shard is not sorted in one task.  Its rows are cut at equal hash distances into buckets of
    about ``ROWS_PER_BUCKET``; a row's slot is its place in the bucket after the rows of the
    buckets before, which a table of one row per bucket gives.
    """
    buckets = max(1, rows.count() // (shards * ROWS_PER_BUCKET))
    bucket = F.expr(f"cast(_hash * {buckets} as decimal(38,0)) div {_TWO64}")
    cut = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("shard", "_bucket")
        .count()
        .select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("_hash", *order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_start")
    )


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more for the end of the line."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    light = docs.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(assign(light, "doc_id", shards), ["doc_id", "size", "text_crc32"], shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
