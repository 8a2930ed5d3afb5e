"""Product codes of vectors: a codebook per part, trained and applied through metric trees.

1. Vectors become integers, floor(scale * x), and are cut into ``parts`` equal parts.
2. Every block of up to ``BLOCK`` vectors gets one tree per part, once.  It grows from the middle:
   the anchors hierarchy takes the point farthest from its anchor as the next anchor, which wins
   points only from anchors nearer than twice those points' distance; the balls of the anchors are
   merged upwards, least merged ball first, and split downwards in the same way.  Each ball caches
   the sum, count and squared radius of its points.  The trees are written and read in each round.
3. A round goes down the trees with a list of candidate entries per ball.  A child inherits what its
   parent left over.  An entry goes where the one nearest to the ball's pivot is nearer for every
   point the ball can hold; a ball with one entry left gives it its cached sum and count, and only
   leaves with several compare their points.  Sums are combined per task and then per entry; the
   driver gets one row per part and entry.
4. The last assignment goes down the same way and keeps each point's entry and squared distance.

Everything that decides is on integers.  The ball test alone is in floating point, with a margin
that can only keep an entry for longer.  Ties go to the lower index, so of equal entries the first
wins.  A component beyond ``LARGEST_COMPONENT`` after scaling ends the job with an error.

Vectors that are null or hold null or non-finite components are left out.  The length is that of the
vector with the least id that is not empty, and must be a multiple of ``parts``; vectors of another
length keep their row, with null code and error.  With fewer vectors than entries a codebook is shorter; an empty table
gives no rows.  Null ids sort last, repeated ids by their vector, and repeated rows get equal
results.  Null labels are one label.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from threatlake.llm.common import finite_vector, scaled_integers, written

BLOCK = 4096
LEAF = 32
BROADCAST_LABELS = 100_000

_PAIRS = 1 << 18  # points times entries compared at once


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of its anchor for every point, the anchors, and their squared radius."""
    anchors = [0]
    owner = np.zeros(len(points), np.int64)
    far = _squared(points, points[:1])
    for _ in range(int(np.sqrt(len(points)))):
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = _squared(points[anchors], points[new : new + 1])
        # Nearer to its anchor than half way to the new one: a point cannot change.
        asked = np.flatnonzero(4 * far > between[owner])
        near = _squared(points[asked], points[new : new + 1])
        won = near < far[asked]
        owner[asked[won]], far[asked[won]] = len(anchors), near[won]
        anchors.append(new)
    radius = np.zeros(len(anchors), np.int64)
    np.maximum.at(radius, owner, far)
    return owner, points[anchors], radius


def _merges(centers: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls in the order to merge them; the ball of the n-th merge has number k + n."""
    k = len(centers)
    if k < 2:
        return []
    centers, radius = centers.astype(float), np.sqrt(radius.astype(float))
    name = list(range(k))
    gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))
    size = np.maximum((gap + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
    np.fill_diagonal(size, np.inf)
    out = []
    for n in range(k - 1):
        i, j = divmod(int(size.argmin()), k)
        out.append((name[i], name[j]))
        name[i] = k + n
        grown = size[i, j]
        between = np.sqrt(((centers[i] - centers[j]) ** 2).sum())
        if grown > radius[i]:
            # The least ball around both: its center lies between theirs.
            share = (grown - radius[i]) / between if between else 0.0
            centers[i] = centers[i] + share * (centers[j] - centers[i])
        radius[i] = grown
        own = np.sqrt(((centers - centers[i]) ** 2).sum(axis=1))
        own = np.maximum((own + radius + grown) / 2, np.maximum(radius, grown))
        own[~np.isfinite(size).any(axis=1)] = np.inf
        own[i] = np.inf
        size[i], size[:, i] = own, own
        size[j], size[:, j] = np.inf, np.inf
    return out


@dataclass
class Forest:
    """Trees over points; a ball's points are rows ``low`` to ``high``, a leaf has no children."""

    points: np.ndarray
    source: np.ndarray  # row of each point in its block
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    radius: np.ndarray  # squared, around the floored mean

    def pivots(self, nodes: np.ndarray) -> np.ndarray:
        return self.sums[nodes] // (self.high - self.low)[nodes][:, None]


def tree(points: np.ndarray) -> Forest:
    """One tree, its root first, with the points in the order of its leaves."""
    left, right, members = [-1], [-1], [None]
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        owner, centers, radius = _anchors(points[own]) if len(own) > LEAF else (None, [0], None)
        if len(centers) == 1:
            members[node] = own
            continue
        first, merges = len(left), _merges(centers, radius)
        k = len(centers)
        left += [-1] * (2 * k - 2)
        right += [-1] * (2 * k - 2)
        members += [None] * (2 * k - 2)
        for n, (a, b) in enumerate(merges):
            at = node if n == k - 2 else first + k + n
            left[at], right[at] = first + a, first + b
        todo += [(first + i, own[owner == i]) for i in range(k)]
    low, high = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    order, at, visited, stack = [], 0, [], [0]
    while stack:
        node = stack.pop()
        visited.append(node)
        if left[node] < 0:
            order.append(members[node])
            low[node], high[node] = at, at + len(members[node])
            at = high[node]
        else:
            stack += [right[node], left[node]]
    for node in reversed(visited):
        if left[node] >= 0:
            low[node], high[node] = low[left[node]], high[right[node]]
    source = np.concatenate(order)
    points = points[source]
    total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points, axis=0, out=total[1:])
    found = Forest(points, source, low, high, np.array(left), np.array(right), total[high] - total[low], low)
    sizes = high - low
    radius = np.zeros(len(low), np.int64)
    pivots = found.pivots(np.arange(len(low)))
    for a, b in _chunks(sizes):
        gaps = _squared(points[_runs(low[a:b], sizes[a:b])], np.repeat(pivots[a:b], sizes[a:b], axis=0))
        radius[a:b] = np.maximum.reduceat(gaps, np.cumsum(sizes[a:b]) - sizes[a:b])
    found.radius = radius
    return found


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of whole runs of about ``_PAIRS`` together."""
    group = (np.cumsum(sizes) - sizes) // _PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def forest(vectors: np.ndarray, parts: int) -> tuple[Forest, np.ndarray]:
    """A tree per part in one structure, and the number of each root."""
    width = vectors.shape[1] // parts
    trees = [tree(np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])) for p in range(parts)]
    shift = np.cumsum([0, *(len(t.low) for t in trees)])
    n = len(vectors)

    def linked(side: str) -> np.ndarray:
        return np.concatenate([np.where(getattr(t, side) < 0, -1, getattr(t, side) + s) for t, s in zip(trees, shift, strict=False)])

    joined = Forest(
        np.concatenate([t.points for t in trees]),
        np.concatenate([t.source for t in trees]),
        np.concatenate([t.low + p * n for p, t in enumerate(trees)]),
        np.concatenate([t.high + p * n for p, t in enumerate(trees)]),
        linked("left"), linked("right"),
        np.concatenate([t.sums for t in trees]), np.concatenate([t.radius for t in trees]),
    )
    return joined, shift[:-1]


@dataclass
class Owned:
    """Runs of points that one entry owns; ``cached`` says which run is a whole ball."""

    low: np.ndarray
    high: np.ndarray
    entry: np.ndarray
    sums: np.ndarray


def assign(trees: Forest, roots: np.ndarray, books: np.ndarray) -> Iterator[Owned]:
    """Entries (numbered over all parts) of all points, ball by ball.

    ``books`` has the entries of all parts, one part after the other, ``len(books) / len(roots)`` each.
    """
    each = len(books) // len(roots)
    nodes, counts = roots, np.full(len(roots), each)
    entries = np.arange(len(books))
    while len(nodes):
        starts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(nodes)), counts)
        gap = _squared(trees.pivots(nodes)[of], books[entries])
        gap -= np.minimum.reduceat(gap, starts)[of]
        at = np.flatnonzero(gap == 0)
        # Entries ascend within a ball, so the first nearest one has the lowest index.
        nearest = entries[at[np.unique(of[at], return_index=True)[1]]]
        apart = _squared(books[entries], books[nearest][of])
        reach = 2 * np.sqrt(trees.radius[nodes].astype(float))[of] * np.sqrt(apart.astype(float))
        goes = gap * (1 - 1e-9) > reach * (1 + 1e-9)
        goes |= (apart == 0) | (trees.radius[nodes] == 0)[of]
        stays = ~goes | (entries == nearest[of])
        entries, counts = entries[stays], np.add.reduceat(stays.astype(np.int64), starts)
        starts = np.cumsum(counts) - counts
        whole = counts == 1
        ball = nodes[whole]
        yield Owned(trees.low[ball], trees.high[ball], entries[starts[whole]], trees.sums[ball])
        leaf = ~whole & (trees.left[nodes] < 0)
        yield from _compared(trees, nodes[leaf], entries, starts[leaf], counts[leaf], books)
        inner = ~whole & ~leaf
        children = np.stack([trees.left[nodes[inner]], trees.right[nodes[inner]]], axis=1).ravel()
        twice = np.repeat(starts[inner], 2), np.repeat(counts[inner], 2)
        nodes, counts, entries = children, twice[1], entries[_runs(*twice)]


def _compared(trees: Forest, leaves, entries, starts, counts, books) -> Iterator[Owned]:
    """The points of leaves, each with the nearest of the entries its leaf has left."""
    sizes = trees.high[leaves] - trees.low[leaves]
    for a, b in _chunks(sizes * counts):
        rows = _runs(trees.low[leaves[a:b]], sizes[a:b])
        each, first = np.repeat(counts[a:b], sizes[a:b]), np.repeat(starts[a:b], sizes[a:b])
        asked = entries[_runs(first, each)]
        of = np.repeat(np.arange(len(rows)), each)
        gap = _squared(trees.points[rows][of], books[asked])
        at = np.flatnonzero(gap == np.minimum.reduceat(gap, np.cumsum(each) - each)[of])
        best = asked[at[np.unique(of[at], return_index=True)[1]]]
        yield Owned(rows, rows + 1, best, trees.points[rows])


# --- as Spark jobs ------------------------------------------------------------------------------------

_FIELDS = {
    "points": "i4", "source": "i4", "low": "i4", "high": "i4", "left": "i4", "right": "i4",
    "sums": "i8", "radius": "i8",
}


def _grow(parts: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                trees, roots = forest(flat.reshape(part.num_rows, -1), parts)
                whole = pa.array([0, part.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(whole, part.column(i)) for i in (0, 1)]
                columns.append(pa.array([roots.astype("<i4").tobytes()], pa.binary()))
                for name, kind in _FIELDS.items():
                    columns.append(pa.array([getattr(trees, name).astype("<" + kind).tobytes()], pa.binary()))
                yield pa.record_batch(columns, names)

    return run


def _grown(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, Forest, np.ndarray]]:
    for i in range(batch.num_rows):
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(batch.column(name)[i].as_py(), "<" + kind).astype(np.int64)  # noqa: B023

        found = {name: numbers(name, kind) for name, kind in _FIELDS.items()}
        for name in ("points", "sums"):
            found[name] = found[name].reshape(-1, width)
        yield i, Forest(**found), numbers("roots", "i4")


def _partial(books: np.ndarray):
    width = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(len(books), np.int64)
        for batch in batches:
            for _, trees, roots in _grown(batch, width):
                for own in assign(trees, roots, books):
                    np.add.at(sums, own.entry, own.sums)
                    np.add.at(counts, own.entry, own.high - own.low)
        used = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.int64())), pa.array(counts[used])],
            ["entry", "sums", "n"],
        )

    return run


def _encode(books: np.ndarray, parts: int, names: list[str]):
    width, each = books.shape[1], len(books) // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees, roots in _grown(batch, width):
                entry = np.zeros(len(trees.points), np.int64)
                for own in assign(trees, roots, books):
                    sizes = own.high - own.low
                    entry[_runs(own.low, sizes)] = np.repeat(own.entry, sizes)
                n = len(entry) // parts
                gap = _squared(trees.points, books[entry])
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                part = np.repeat(np.arange(parts), n)
                codes[trees.source, part] = entry - part * each
                np.add.at(errors, trees.source, gap)
                ids, labels = (batch.column(k).slice(i, 1).flatten() for k in (0, 1))
                text = pa.array([row.tobytes().hex() for row in codes], pa.string())
                yield pa.record_batch([ids, labels, text, pa.array(errors)], names)

    return run


@dataclass
class Codes:
    rows: DataFrame  # id, label, code, error: written
    codebooks: np.ndarray  # parts x entries x width

    def with_label_error(self, label_col: str = "label") -> DataFrame:
        """The rows with the error summed over their label; sums are broadcast while labels are few."""
        sums = self.rows.groupBy(label_col).agg(F.sum("error").alias("label_error"))
        sums = written(sums.withColumnRenamed(label_col, "_label"), "label-errors")
        if sums.count() <= BROADCAST_LABELS:
            sums = F.broadcast(sums)
        return self.rows.join(sums, F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")


def _uncoded(id_col: str, label_col: str) -> list[Column]:
    none = F.lit(None)
    code, error = none.cast("string").alias("code"), none.cast("bigint").alias("error")
    return [F.col("id").alias(id_col), F.col("label").alias(label_col), code, error]


def encode(
    table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> Codes:
    """Codes of all vectors after ``rounds`` of moving the codebooks' entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part")
    kept = table.where(finite_vector(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")
    )
    out = StructType([table.schema[id_col], table.schema[label_col]]).add("code", "string").add("error", "long")
    order = [F.col("id").asc_nulls_last(), "v"]
    leading = kept.where(F.size("v") > 0).orderBy(*order).limit(1).select(F.size("v")).first()
    dims = leading[0] if leading else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} parts")
    if not dims:
        return Codes(kept.select(*_uncoded(id_col, label_col)), np.zeros((parts, 0, 0), np.int64))
    fits = F.size("v") == dims
    whole = kept.where(fits).withColumn("v", scaled_integers(F.col("v"), scale))
    first = np.array([r["v"] for r in whole.orderBy(*order).limit(entries).collect()], np.int64)
    width = dims // parts
    # One part's entries after the other's.
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).reshape(-1, width)
    kinds = whole.schema
    schema = StructType().add("ids", ArrayType(kinds["id"].dataType)).add("labels", ArrayType(kinds["label"].dataType))
    for name in ("roots", *_FIELDS):
        schema = schema.add(name, "binary")
    trees = written(whole.mapInArrow(_grow(parts, schema.names), schema), "trees")
    for _ in range(rounds):
        # The codebooks travel with the task: parts x entries x width numbers.
        moved = trees.mapInArrow(_partial(books), "entry int, sums array<bigint>, n bigint")
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        for row in moved.groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    coded = trees.mapInArrow(_encode(books, parts, out.names), out)
    other = kept.where(~fits).select(*_uncoded(id_col, label_col))
    return Codes(written(coded.unionByName(other), "codes"), books.reshape(parts, -1, width))
