"""Documents linked by the Jaccard similarity of their word shingles, as components.

Texts with equal shingle sets form a class; only classes are joined, so copies are never paired.

1. One pass gives every document its class (a 128-bit digest of the sorted set) and the size of the
   set, and counts all shingles in a table of hashed counters.  The counters make one global order
   of shingles, rarest first; their number is bounded, and a fuller table only sorts less well.
2. A second pass emits the prefix of each class: so many of its rarest shingles that two similar
   sets must share one.  Prefix shingles that a single class has are dropped.
3. Candidates share a prefix shingle and pass the length filter (sizes), the positional filter (what
   can still follow the shared shingle) and the suffix filter (the sets' sizes per hash range bound
   their overlap).  Each pair is verified once, on the whole sets.  Where all members of a shingle meet,
   a sketch of 512 bits per class is compared inside the join already: every shingle flips one bit, so
   two sets differ in at least as many shingles as their sketches differ in bits.  Sets too large for
   that many bits take their sizes per hash range along as well.

A shingle that many classes have would give a pair for every two of them.  So its members are first
compared with the least and the greatest member of like size, and linked members get a common
component.  A second round then takes all pairs of members of different components, and skips
shingles with a single component.  A pair inside one component could not change the result.

Null texts and texts without words have no set and are linked with nothing; a text of fewer words
than a shingle is one shingle.  Repeated rows share a class.  A null doc_id is no component's
smallest id unless there is no other.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatlake.functions.columns import let
from threatlake.llm.common import SLICE_ROWS, free_name, sliced, written

COUNTERS = 1 << 22
BROADCAST_CLASSES = 500_000
HUB_LABEL_ROUNDS = 3

_BLOCK = 1 << 16
_HELD = 1 << 18
_RANGES = 256
_MOST_IN_RANGE = 127
_SKETCH_WORDS = 8
_SKETCH_FULL = 200  # different bits; unlike sketches differ in about 256
_SALTS = 16
_PASS1 = (
    "doc_id bigint, fp bigint, n int, c1 bigint, c2 bigint, ranges array<tinyint>,"
    " sketch array<bigint>, block int, counts binary"
)
_POSTINGS = "token bigint, c1 bigint, c2 bigint, n int, pos int"
_SETS = "c1 bigint, c2 bigint, shingles array<bigint>"

def _mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finalizer (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash per word; a memo of them took more time than it saved, and memory beside the heap."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    # bytes.lower and bytes.split know ASCII letters and white space only.
    words = _word_hashes((text or "").encode().lower().split())
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mix(out + words[k : k + count])
    return np.unique(out)


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether each of 512 classes of hashes holds an odd number of the shingles, as bits of words."""
    bits = np.bincount(((shingles >> np.uint64(32)) % np.uint64(64 * _SKETCH_WORDS)).astype(np.int64), minlength=64 * _SKETCH_WORDS)
    return np.packbits(bits & 1).view(np.int64)


def _first_pass(size: int):
    names = [c.split()[0] for c in _PASS1.split(", ")]
    kinds = [
        pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int64()),
        pa.int32(), pa.binary(),
    ]

    def rows(columns: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, waiting, held = np.zeros(COUNTERS, np.uint32), set(), [], 0
        for batch in sliced(batches, 4 * SLICE_ROWS):
            sizes, classes, ranges, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, size)
                sizes.append(len(own))
                classes.append(_class_of(own) if len(own) else (None, None))
                held_by = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=_RANGES)
                # Cut sizes differ by no more than whole ones.
                ranges.append(np.minimum(held_by, _MOST_IN_RANGE).astype(np.int8))
                sketches.append(sketch(own))
                if len(own) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    waiting.append(_slot(own))
                    held += len(own)
                if held >= _HELD:
                    np.add.at(counts, np.concatenate(waiting), np.uint32(1))
                    waiting, held = [], 0
            n, none = len(sizes), [None] * len(sizes)
            c1, c2 = zip(*classes, strict=True) if n else ((), ())
            yield rows([batch.column(0), batch.column(1), sizes, list(c1), list(c2), ranges, sketches, none, none])
        if waiting:
            np.add.at(counts, np.concatenate(waiting), np.uint32(1))
        blocks = [b for b in range(COUNTERS // _BLOCK) if counts[b * _BLOCK : (b + 1) * _BLOCK].any()]
        if blocks:
            none = [None] * len(blocks)
            parts = [counts[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in blocks]
            yield rows([none] * 7 + [blocks, parts])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counter blocks; holds one sum per block, however many tasks sent parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(part.as_buffer(), np.uint32)
            sums[block] = sums[block] + own if block in sums else own.astype(np.uint64)
    found = [np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()]
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(found, pa.binary())], ["block", "counts"])


def _prefixes(shared, size: int, percent: int):
    names = [c.split()[0] for c in _POSTINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in sliced(batches, 4 * SLICE_ROWS):
            columns: list[list] = [[] for _ in names]
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, size)
                n = len(own)
                key = _class_of(own) if n else None
                if not n or key in seen:
                    continue
                seen.add(key)
                keep = n - -(-percent * n // 100) + 1
                place = np.lexsort((own, counts[_slot(own)]))[:keep]
                values = (own[place].view(np.int64), *key, n, np.arange(keep))
                for column, value in zip(columns, values, strict=True):
                    column.append(value if isinstance(value, np.ndarray) else np.full(keep, value))
            kinds = [np.int64, np.int64, np.int64, np.int32, np.int32]
            arrays = [
                pa.array(np.concatenate(c).astype(k) if c else np.zeros(0, k))
                for c, k in zip(columns, kinds, strict=True)
            ]
            yield pa.record_batch(arrays, names)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4 * SLICE_ROWS):
            own = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            classes = [_class_of(s) for s in own]
            yield pa.record_batch(
                [
                    pa.array([c[0] for c in classes], pa.int64()),
                    pa.array([c[1] for c in classes], pa.int64()),
                    pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                ],
                ["c1", "c2", "shingles"],
            )

    return run


def connected(edges: DataFrame, labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, label: the least node that links (a, b) reach, by least neighbours and pointer jumps.

    ``labels`` holds what is known so far, each node at first its own label.  After ``rounds`` rounds
    a label is some node that its own reaches, so equal labels mean a path; without ``rounds`` it
    goes on until nothing changes.  Every round is written, so that a lost executor repeats one.
    """
    both = written(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    done = 0
    while rounds is None or done < rounds:
        least = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(least, labels["node"] == least["a"], "left").select(
            "node", F.col("label").alias("old"), F.coalesce(F.least("label", "near"), "label").alias("step")
        )
        stepped = written(stepped, "labels-step")
        above = stepped.select(F.col("node").alias("up"), F.col("step").alias("top"))
        jumped = written(
            stepped.join(above, stepped["step"] == above["up"]).select("node", "old", F.col("top").alias("label")),
            "labels",
        )
        labels = jumped.select("node", "label")
        done += 1
        if rounds is None and jumped.where(F.col("old") != F.col("label")).isEmpty():
            break
    return labels


def _may_overlap(percent: int, shared_at_a: Column, shared_at_b: Column) -> Column:
    """Length and positional filters for sizes a_n, b_n and places of the shared shingle."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    # The shared shingle and what follows it, and what comes before it in both prefixes.
    most = F.least(F.col("a_n") - shared_at_a, F.col("b_n") - shared_at_b) + F.least(shared_at_a, shared_at_b)
    enough = (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))
    return (100 * small >= percent * large) & enough


def _sketches_near(percent: int) -> Column:
    """Sizes a_n, b_n allow as many differing shingles as the sketches, and ranges if any, show at the least."""
    words = [F.bit_count(F.get("a_sketch", F.lit(i)).bitwiseXOR(F.get("b_sketch", F.lit(i)))) for i in range(_SKETCH_WORDS)]
    return _room(sum(words[1:], words[0]), percent) & F.coalesce(_room(_apart("a_large", "b_large"), percent), F.lit(True))


def _apart(a: str, b: str) -> Column:
    """By how much the sizes per hash range differ, all together."""
    each = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _room(differing: Column, percent: int) -> Column:
    """|a xor b| is at least ``differing``, and at most (100 - percent) / (100 + percent) of both sizes."""
    return (100 + percent) * differing <= (100 - percent) * (F.col("a_n") + F.col("b_n"))


def _sketched(labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Labels with sketches; ranges too where a set may differ from its like in most bits of a sketch."""
    large = (100 - percent) * 2 * F.col("n") > (100 + percent) * _SKETCH_FULL
    own = classes.select(F.col("cls").alias("node"), "sketch", F.when(large, F.col("ranges")).alias("large"))
    return labels.join(own, "node")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: pairs whose sizes per hash range leave room for the overlap."""
    light = classes.select("cls", "ranges")
    a_light = light.select(F.col("cls").alias("a"), F.col("ranges").alias("a_r"))
    b_light = light.select(F.col("cls").alias("b"), F.col("ranges").alias("b_r"))
    possible = _room(_apart("a_r", "b_r"), percent)
    return pairs.join(a_light, "a").join(b_light, "b").where(possible).drop("a_r", "b_r")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, by their whole sets."""
    a_sets = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("a_s"))
    b_sets = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("b_s"))
    linked = let(
        F.size(F.array_intersect("a_s", "b_s")),
        lambda both: 100 * both >= percent * (F.col("a_n") + F.col("b_n") - both),
    )
    return pairs.join(a_sets, "a").join(b_sets, "b").where(linked).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lesser class first."""
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("b_n")).otherwise(F.col("a_n")).alias("a_n"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(swap, F.col("a_n")).otherwise(F.col("b_n")).alias("b_n"),
    ).distinct()


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Every member with its shingle's least and greatest one of the same size band."""
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100)).alias("band")
    banded = postings.select("token", "cls", "n", "pos", band)
    member = F.struct("n", "cls", "pos")
    hubs = banded.groupBy("token", "band").agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
    hubs = hubs.where(F.col("lo.cls") != F.col("hi.cls")).select(
        "token", "band", F.explode(F.array("lo", "hi")).alias("hub")
    )
    joined = banded.join(hubs, ["token", "band"]).where(F.col("cls") != F.col("hub.cls"))
    named = joined.select(
        F.col("hub.cls").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.pos").alias("a_pos"),
        F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"),
    )
    return _ordered(named.where(_may_overlap(percent, F.col("a_pos"), F.col("b_pos"))))


def _cross_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of different components that pass the filters."""
    mixed = (
        postings.groupBy("token")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("token")
    )
    left = postings.join(mixed, "token", "left_semi")
    a = left.select("token", *[F.col(c).alias(f"a_{c}") for c in ("cls", "n", "pos", "label", "sketch", "large")])
    b = left.select("token", *[F.col(c).alias(f"b_{c}") for c in ("cls", "n", "pos", "label", "sketch", "large")])
    fits = _may_overlap(percent, F.col("a_pos"), F.col("b_pos"))
    apart = (F.col("a_label") != F.col("b_label")) & (F.col("a_cls") < F.col("b_cls"))
    joined = a.join(b, (a["token"] == b["token"]) & apart & fits & _sketches_near(percent))
    return joined.select(F.col("a_cls").alias("a"), "a_n", F.col("b_cls").alias("b"), "b_n").distinct()


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return postings.join(labels, postings["cls"] == labels["node"]).drop("node")


def components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, fp (hash of the text), n_shingles, component_id."""
    spark = docs.sparkSession
    fp = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text"))
    keyed = docs.select(F.col("doc_id").cast("bigint"), fp.alias("fp"), "text")
    first = written(keyed.mapInArrow(_first_pass(size), _PASS1), "classes")
    cls = F.struct("c1", "c2")
    documents = first.where(F.col("block").isNull()).select("doc_id", "fp", "n", cls.alias("cls"), "ranges", "sketch")
    parts = first.where(F.col("block").isNotNull()).select("block", "counts")
    counts = np.zeros(COUNTERS, np.uint32)  # bounded: one number per counter
    for block, values in parts.repartition("block").mapInArrow(_add_blocks, "block int, counts binary").collect():
        counts[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(values, np.uint32)
    shared = spark.sparkContext.broadcast(counts)

    everyone = Window.partitionBy("token")
    emitted = keyed.select("text").mapInArrow(_prefixes(shared, size, percent), _POSTINGS)
    several = emitted.withColumns(
        {"lo": F.min(cls).over(everyone), "hi": F.max(cls).over(everyone)}
    ).where(F.col("lo") != F.col("hi"))
    postings = written(
        several.select("token", cls.alias("cls"), "n", "pos").dropDuplicates(["token", "cls"]), "postings"
    )

    classes = (
        documents.where("n > 0")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "fp")).alias("chosen"),
            F.count("*").alias("members"),
            F.min("n").alias("n"),
            F.min("ranges").alias("ranges"),
            F.min("sketch").alias("sketch"),
        )
    )
    active = written(classes.join(postings.select("cls").distinct(), "cls", "left_semi"), "active")
    repeats = not documents.groupBy("doc_id", "fp").count().where("count > 1").isEmpty()

    def links_of(pairs: DataFrame) -> DataFrame:
        """The sets of the pairs' classes are made again from one text of each."""
        named = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = active.join(named, "cls", "left_semi").select(
            F.col("chosen.doc_id").alias("w_id"), F.col("chosen.fp").alias("w_fp")
        )
        if active.count() <= BROADCAST_CLASSES:
            wanted = F.broadcast(wanted)
        same = keyed["doc_id"].eqNullSafe(wanted["w_id"]) & (keyed["fp"] == wanted["w_fp"])
        texts = keyed.join(wanted, same, "left_semi")
        sets = texts.select("text").mapInArrow(_sets(size), _SETS).select(cls.alias("cls"), "shingles")
        sets = written(sets.dropDuplicates(["cls"]) if repeats else sets, "shingle-sets")
        return written(_verified(pairs, sets, percent), "links")

    nodes = active.select(F.col("cls").alias("node"))
    labels = nodes.select("node", F.col("node").alias("label"))
    hub_pairs = written(_possible(_hub_pairs(postings, percent), active, percent), "pairs")
    hub_links = links_of(hub_pairs)
    labels = connected(hub_links, labels, HUB_LABEL_ROUNDS)
    rest = _cross_pairs(_labelled(postings, _sketched(labels, active, percent)), percent)
    rest = rest.join(hub_pairs.select("a", "b"), ["a", "b"], "left_anti")
    rest_pairs = written(_possible(rest, active, percent), "pairs")
    labels = connected(hub_links.unionAll(links_of(rest_pairs)), labels)

    # The smallest id of a component, for classes that have links or several members.
    ids = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "cls", "least", "members", "label"
    )
    of_label = ids.where("label is not null").groupBy("label").agg(F.min("least").alias("of_label"))
    named = (
        ids.join(of_label, "label", "left")
        .where("members > 1 or label is not null")
        .select(
            "cls", F.coalesce("of_label", "least").alias("component"),
            F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")).alias("salt"),
        )
    )
    full = documents.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "fp"), F.lit(_SALTS)))
    linked = full.join(named, ["cls", "salt"], "left").select(
        "doc_id", "fp", "n", F.coalesce("component", "doc_id").alias("component")
    )
    empty = documents.where("n = 0").select("doc_id", "fp", "n", F.col("doc_id").alias("component"))
    return linked.unionAll(empty).select(
        "doc_id", "fp", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the smallest doc_id, then the least text hash.

    All columns are kept as they were.  Of rows that repeat id and text of the one that stays, one
    stays.  Documents without words stay; they are linked with nothing.
    """
    found = written(components(docs, size, percent), "components")
    linked = found.where(F.col("n_shingles") > 0)
    chosen = (
        linked.groupBy("component_id")
        .agg(F.min(F.struct("doc_id", "fp")).alias("keep"))
        .select(F.col("keep.doc_id").alias("_k_id"), F.col("keep.fp").alias("_k_fp"))
    )
    empty = found.where(F.col("n_shingles") == 0).select(F.col("doc_id").alias("_k_id"), F.col("fp").alias("_k_fp"))
    fp = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text"))
    own_id, own_fp = free_name(docs, "_id"), free_name(docs, "_fp")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("bigint"), own_fp: fp})

    # Ids and hashes of the documents that stay: broadcast while they are few, else shuffled.
    few = found.count() <= BROADCAST_CLASSES

    def only(rows: DataFrame, which: DataFrame) -> DataFrame:
        which = F.broadcast(which) if few else which
        same = rows[own_id].eqNullSafe(which["_k_id"]) & (rows[own_fp] == which["_k_fp"])
        return rows.join(which, same, "left_semi")

    if linked.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        return only(keyed, chosen.unionAll(empty).distinct()).drop(own_id, own_fp)
    single = only(keyed, chosen).dropDuplicates([own_id, own_fp])
    return single.unionAll(only(keyed, empty.distinct())).drop(own_id, own_fp)
