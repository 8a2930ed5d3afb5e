"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Documents become ids plus an end id; only documents longer than a sequence are cut, into whole
sequences after a first piece that takes the rest.  A whole sequence is a bin of its own.  All
other pieces (one per document at most) are dealt by a hash into groups of about
``PIECES_PER_GROUP``, and each group is packed by best-fit decreasing: a segment tree over the
remaining capacities gives the tightest open bin in logarithmic time.  A group is large enough
that its last open bins are a tiny share, and small enough for one task; their number follows the
count of such pieces.  The fullest possible packing of a group does not depend on its neighbours, so a lost
executor repeats its groups alone.

Null texts are empty documents that hold only the end id.  Repeated rows are packed each.  An
empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm import tokenizing
from threatlake.llm.common import written

PIECES_PER_GROUP = 16_384

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Segment tree over capacities 0 to ``capacity``; a node counts the open bins below it."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        node = remaining + self.size
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (remaining, bin) of the smallest remaining capacity >= ``least``."""
        count, node = self.count, least + self.size
        if not count[node]:
            # Up to the first subtree on the right that has a bin, then down its left edge.
            while node > 1 and (node & 1 or not count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        remaining = node - self.size
        while node:
            count[node] -= 1
            node //= 2
        return remaining, self.bins[remaining].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (1 to ``capacity``)."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(length)
        if found is None:
            remaining, number, opened = capacity, opened, opened + 1
        else:
            remaining, number = found
        bins[i], offsets[i] = number, capacity - remaining
        if remaining > length:
            tree.add(remaining - length, number)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and on request ids (unsigned 32-bit)."""
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(own), *[own] * with_ids))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
    return texts.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces; any other columns stay.

    The pieces are written first.  Whole sequences need no place beside others and go through as
    they are, under numbers below 0; the number of groups is counted from the rest.
    """
    stored = written(cut, "pieces")
    number = F.lit(-1).cast("bigint") - F.monotonically_increasing_id()
    whole = stored.where(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": number, "offset": F.lit(0).cast("bigint")})
    parts = stored.where(F.col("length") < capacity)
    groups = max(1, round(parts.count() / PIECES_PER_GROUP))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    out = dealt.drop("_group").schema.add("sequence_id", "long").add("offset", "long")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Neither the order of arrival nor equal lengths may change which piece goes where.
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="_group").assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    return dealt.groupBy("_group").applyInPandas(place, out).unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (unsigned 32-bit), from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(
            F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda whole, p: F.concat(whole, p)
        ).alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity, with_ids), capacity)
