"""Lines that many documents share, found with two Bloom filters.

1. Every task hashes its documents' line keys (once per document) and marks them in a filter of
   hashes seen once and a filter of hashes seen twice.  Merging the tasks' marks block by block,
   a bit that two tasks saw once counts as seen twice.
2. Only keys that the second filter holds are suspects.  They alone are shuffled, as text, and
   counted exactly; the first occurrence is chosen there too.
3. Confirmed keys drop their lines.  They are broadcast up to ``BROADCAST_BYTES``; beyond that the
   suspects of each document are joined with them and the documents with their own list.

The filters have 16 bits per line up to ``MAX_FILTER_BITS``; a fuller filter suspects more lines and
changes no result.

A key is a line without ASCII white space at both ends, A-Z in lower case.  A null or empty text
is one empty line; null stays null.  Lines without a key never go.  Repeated rows are documents of
their own.  An empty table gives no rows.  All columns are kept; n_lines and n_dropped replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from threatlake.llm.common import free_name, sliced, written

MAX_FILTER_BITS = 2**28
BITS_PER_LINE = 16
BROADCAST_BYTES = 16 * 2**20

_HASHES = 4
_BLOCK = 16  # bits of a place inside a block of the filter


def line_keys(text: str | None) -> list[bytes]:
    # bytes.lower and bytes.strip know ASCII only, as the keys do.
    return [line.strip() for line in (text or "").encode().lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row per hash; ``bits`` is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(_HASHES, dtype=np.uint64)
    return (hashes[:, None] + step[:, None] * turns) & np.uint64(bits - 1)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _marks(bits: int, least: int) -> Callable:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint64)]
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.append(_hashes([k for k in set(line_keys(text)) if _long_enough(k, least)]))
        hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
        once = np.unique(_places(hashes, bits))
        twice = np.unique(_places(hashes[counts > 1], bits))
        blocks = np.unique(once >> np.uint64(_BLOCK))
        edges = np.append(blocks << np.uint64(_BLOCK), np.uint64(bits))

        def parts(places: np.ndarray) -> pa.Array:
            cuts, low = np.searchsorted(places, edges), places.astype(np.uint16)
            each = [low[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.array(each, pa.binary())

        columns = [pa.array(blocks.astype(np.int32)), parts(once), parts(twice)]
        yield pa.record_batch(columns, ["block", "once", "twice"])

    return mark


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits seen once by two tasks, or twice by one; holds one count per bit of its blocks."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = seen.setdefault(block, np.zeros(1 << _BLOCK, np.uint8))
            places = np.frombuffer(once, np.uint16)
            own[places] = np.minimum(own[places] + 1, 2)
            own[np.frombuffer(twice, np.uint16)] = 2
    bits = [np.packbits(s > 1, bitorder="little").tobytes() for s in seen.values()]
    yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])


def twice_filter(docs: DataFrame, least: int) -> np.ndarray:
    """The filter of hashes seen twice, as packed bits (at most ``MAX_FILTER_BITS``)."""
    newlines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n")))
    lines = docs.agg(F.sum(F.coalesce(newlines, F.lit(0)) + 1)).first()[0] or 1
    bits = 1 << _BLOCK
    while bits < min(MAX_FILTER_BITS, lines * BITS_PER_LINE):
        bits *= 2
    marks = docs.select("text").mapInArrow(_marks(bits, least), "block int, once binary, twice binary")
    merged = marks.repartition("block").mapInArrow(_merge, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    size = 1 << (_BLOCK - 3)
    for block, part in merged.collect():
        out[block * size : (block + 1) * size] = np.frombuffer(part, np.uint8)
    return out


def _suspected(keys: list[bytes], twice: np.ndarray) -> list[bytes]:
    places = _places(_hashes(keys), 8 * len(twice)).astype(np.int64)
    hit = (twice[places >> 3] >> (places & 7).astype(np.uint8)) & 1
    return [keys[i] for i in np.flatnonzero(hit.all(axis=1))]


def _suspects(shared, least: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, prints, found, lines = [], [], [], []
            columns = (c.to_pylist() for c in batch.columns)
            for doc_id, fp, text in zip(*columns, strict=True):
                place: dict[bytes, int] = {}
                for i, key in enumerate(line_keys(text)):
                    if _long_enough(key, least):
                        place.setdefault(key, i)
                own = _suspected(list(place), shared.value)
                found += own
                lines += [place[k] for k in own]
                ids += [doc_id] * len(own)
                prints += [fp] * len(own)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(lines, pa.int64()),
                 pa.array(found, pa.binary())],
                ["doc_id", "fp", "line", "key"],
            )

    return find


def shared_lines(docs: DataFrame, min_docs: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Suspects (doc_id, fp, line, key) and confirmed keys (key, n_docs, first)."""
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(twice_filter(docs, least))
    keyed = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("fp"), "text")
    suspects = keyed.mapInArrow(_suspects(twice, least), "doc_id bigint, fp bigint, line bigint, key binary")
    confirmed = (
        suspects.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "fp", "line")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )
    return suspects, written(confirmed, "shared-lines")


def _rewrite(schema: StructType, doomed: Callable, keep_first: bool, helpers: tuple[str, str, str]) -> Callable:
    """Drop lines of each text; ``doomed`` gives the keys to drop, and the place each first has.

    ``helpers`` name the columns that are not given back: id, text hash and own list of keys.
    """
    names = schema.names
    own_id, own_fp, own_keys = helpers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = doomed()
        for batch in sliced(batches):
            texts = batch.column(names.index("text")).to_pylist()
            me = list(zip(batch.column(names.index(own_id)).to_pylist(), batch.column(names.index(own_fp)).to_pylist(), strict=True))
            own_lists = batch.column(names.index(own_keys)).to_pylist() if shared is None else None
            out, sizes, dropped = [], [], []
            for r, text in enumerate(texts):
                drop = shared if own_lists is None else {o["key"]: (o["doc_id"], o["fp"], o["line"]) for o in own_lists[r] or []}
                keys = line_keys(text)
                gone = [
                    k in drop and not (keep_first and drop[k] == (*me[r], i)) for i, k in enumerate(keys)
                ]
                n = sum(gone)
                if n:
                    text = "\n".join(t for t, g in zip(text.split("\n"), gone, strict=True) if not g)
                out.append(text)
                sizes.append(len(keys))
                dropped.append(n)
            columns = {n: c for n, c in zip(names, batch.columns, strict=True) if n not in helpers}
            columns["text"] = pa.array(out, batch.schema.field("text").type)
            columns |= {"n_lines": pa.array(sizes, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.record_batch(list(columns.values()), list(columns))

    return run


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, least: int = 1, keep_first: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents without the lines of keys that at least ``min_docs`` of them have.

    With ``keep_first`` the first line of each such key stays (least doc_id, then place).
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    suspects, confirmed = shared_lines(docs, min_docs, least)
    size = confirmed.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0
    helpers = tuple(free_name(docs, name) for name in ("_id", "_fp", "_own"))
    own_id, own_fp, own_keys = helpers
    with_id = docs.withColumns({own_id: F.col("doc_id").cast("bigint"), own_fp: F.xxhash64("text")})
    out = StructType([*docs.schema.fields])
    out = out.add("n_lines", LongType()).add("n_dropped", LongType())
    if size <= broadcast_bytes:
        rows = confirmed.select("key", "first.*").collect()
        shared = spark.sparkContext.broadcast({bytes(k): tuple(place) for k, *place in rows})
        return with_id.mapInArrow(_rewrite(with_id.schema, lambda: shared.value, keep_first, helpers), out)
    lists = (
        suspects.select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp), "key")
        .distinct()
        .join(confirmed.select("key", "first"), "key")
        .groupBy(own_id, own_fp)
        .agg(F.collect_list(F.struct("key", "first.*")).alias(own_keys))
    )
    same = with_id[own_id].eqNullSafe(lists[own_id]) & (with_id[own_fp] == lists[own_fp])
    joined = with_id.join(lists, same, "left").select(*[with_id[c] for c in with_id.columns], own_keys)
    return joined.mapInArrow(_rewrite(joined.schema, lambda: None, keep_first, helpers), out)
