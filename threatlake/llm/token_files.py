"""Token files: canonical length-limited Huffman codes over blocks of whole documents.

Writing: texts become ids (kept in the scratch folder), the ids of the whole corpus are counted,
and code lengths come from the counts alone (package-merge, so no code is longer than a table
look-up).  Documents are dealt by ranges of doc_id; each range writes blocks of whole documents.
A block is independent: it has the bit stream, its documents' ids and lengths, and the bit offset
of every ``STEP``-th token.

Reading: the checkpoints of a block are decoded side by side with one table look-up per token.

A file set is a folder with ``codes`` (id, length) and ``blocks`` as Parquet.  Null texts are empty
documents that hold only the end id.  Documents that share an id follow each other in the order of
their length and checksum; a null id comes first.  An empty table gives an empty file set.  Only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threatlake.llm import tokenizing
from threatlake.llm.common import sliced
from threatlake.session import scratch_path

STEP = 256
BLOCK_TOKENS = 1 << 18
MAX_BITS = 16
ROWS_PER_RANGE = 20_000

_IDS = (
    "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary, "
    "seen array<bigint>, often array<bigint>"
)
_BLOCKS = (
    "part int, block int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "checkpoints array<bigint>, bits binary"
)
_DOCS = "part int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def _table(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {
        "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
    }
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.record_batch(arrays, [name for name, _ in fields])


def stored_type(tokenizer: str, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    largest = max(tokenizing.encoder(tokenizer).tokenizer.get_vocab().values(), default=0)
    return "<u2" if max(largest, end_id) < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, stored: str = "<u4") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of 32-bit ids) and ids (type ``stored``) with the end id.

    Every task adds one row without a document: the ids it has seen and how often.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_encoder = tokenizing.encoder(tokenizer)
        total = np.zeros(0, np.int64)
        for batch in sliced(batches):
            raws = [text_encoder.encode(text) + end for text in batch.column(1).to_pylist()]
            ids = [np.frombuffer(raw, "<u4") for raw in raws]
            sizes, crcs = [len(own) for own in ids], [zlib.crc32(raw) for raw in raws]
            seen = np.bincount(np.concatenate(ids), minlength=len(total))
            seen[: len(total)] += total
            total = seen
            kept = [own.astype(stored).tobytes() for own in ids] if stored != "<u4" else raws
            none = [None] * len(kept)
            yield _table(_IDS, [batch.column(0), sizes, crcs, kept, none, none])
        used = np.flatnonzero(total)
        yield _table(_IDS, [[None], [None], [None], [None], [used], [total[used]]])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
    return texts.mapInArrow(encode, _IDS)


def count_ids(ids: DataFrame) -> DataFrame:
    """id, n over all documents."""
    seen = ids.where(F.col("seen").isNotNull()).select(F.arrays_zip("seen", "often").alias("pairs"))
    pairs = seen.select(F.explode("pairs").alias("p"))
    return pairs.groupBy(F.col("p.seen").alias("id")).agg(F.sum("p.often").alias("n"))


def code_lengths(counts: dict[int, int], max_bits: int) -> dict[int, int]:
    """Optimal prefix code lengths of at most ``max_bits`` bits, by package-merge."""
    if len(counts) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    leaves = sorted((n, (i,)) for i, n in counts.items())
    if len(leaves) < 2:
        return {i: 1 for i in counts}
    weights = np.array([n for n, _ in leaves], np.int64)
    # Each level: the merged list's order as counts of leaves; packages are taken from the front.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        is_leaf = np.concatenate([np.ones(len(weights), bool), np.zeros(len(packages), bool)])
        place = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[place], is_leaf[place]
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(len(weights), np.int64)
    take = 2 * len(weights) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return {i: int(n) for (_, (i,)), n in zip(leaves, lengths, strict=True)}


class Codebook:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int]):
        pairs = sorted((n, i) for i, n in lengths.items())
        self.bits = pairs[-1][0] if pairs else 1
        size = max(lengths, default=0) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        table = np.zeros(1 << self.bits, np.uint32)
        used = np.zeros(1 << self.bits, np.uint8)
        code = last = 0
        for n, i in pairs:
            code <<= n - last
            self.code[i], self.length[i] = code, n
            first = code << (self.bits - n)
            table[first : first + (1 << (self.bits - n))] = i
            used[first : first + (1 << (self.bits - n))] = n
            code, last = code + 1, n
        self.symbol_at, self.length_at = table, used.astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream, and the bit offset of every ``STEP``-th token."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        # A code lies in one 32-bit word or reaches into the next; its two halves are joined by
        # word, where they never overlap.
        word = at >> 5
        shifted = self.code[ids] << (64 - (at & 31) - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[word[first]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        size = (int(ends[-1]) + 7) // 8
        return out.astype(">u4").tobytes()[:size], at[::STEP]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All checkpoints step by step together; the last one may end earlier."""
        stream = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
        mask = (1 << self.bits) - 1
        top = 8 * (len(window) - 1)
        for k in range(min(STEP, n)):
            value = (window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & mask
            out[:, k] = self.symbol_at[value]
            at = np.minimum(at + self.length_at[value], top)
        return out.reshape(-1)[:n]


def read_codes(spark: SparkSession, path: str) -> Codebook:
    """At most one row per id of the vocabulary."""
    return Codebook(dict(spark.read.parquet(f"{path}/codes").select("id", "length").collect()))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Write the file set of a corpus in ascending order of doc_id."""
    spark = docs.sparkSession
    kept, stored = scratch_path(spark, "ids"), stored_type(tokenizer, end_id)
    token_ids(docs, tokenizer, end_id, stored).write.option("compression", "zstd").parquet(kept)
    every = spark.read.parquet(kept)
    counts = dict(count_ids(every).collect())  # bounded by the vocabulary
    ids = every.where(F.col("ids").isNotNull()).select("doc_id", "n_tokens", "ids_crc32", "ids")
    while len(counts) > 1 << (max_bits - 1):
        max_bits += 1
    lengths = code_lengths(counts, max_bits)
    rows = [(int(i), int(n)) for i, n in sorted(lengths.items())]
    spark.createDataFrame(rows, "id bigint, length bigint").coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast(Codebook(lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            bits, checkpoints = book.value.encode(np.concatenate([x for _, x in held]))
            sizes = [len(x) for _, x in held]
            row = [part, block, sum(sizes), [d for d, _ in held], sizes, checkpoints, bits]
            return _table(_BLOCKS, [[x] for x in row])

        for batch in sliced(batches):
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(value.as_buffer(), stored)
                held.append((doc_id, own))
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    order = ["doc_id", "n_tokens", "ids_crc32"]
    ranges = max(1, ids.count() // ROWS_PER_RANGE)
    dealt = ids.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(blocks, _BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and on request ids, all from the files.

    ``start`` adds three parts: tokens of the ranges before (one row per range), of the range's
    blocks before, and of the block's documents before.
    """
    book = spark.sparkContext.broadcast(read_codes(spark, path))
    schema = _DOCS + (", ids binary" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, n, doc_ids, sizes, checkpoints, bits = (c[i].as_py() for c in batch.columns)
                ids = book.value.decode(bits, np.array(checkpoints, np.int64), n).astype("<u4")
                ends = np.cumsum(sizes)
                at = ends - sizes
                own = [ids[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
                columns = [[part] * len(own), [block] * len(own), doc_ids, at, sizes, [zlib.crc32(x) for x in own]]
                yield _table(schema, columns + [own] * with_ids)

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    of_parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("_range_start")
    )
    of_blocks = sizes.select(
        "part", "block", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_block_start")
    )
    starts = of_blocks.join(of_parts, "part").withColumn("_from", F.col("_range_start") + F.col("_block_start"))
    found = blocks.mapInArrow(decode, schema).join(starts, ["part", "block"])
    columns = ["doc_id", (F.col("_from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *["ids"] * with_ids)
