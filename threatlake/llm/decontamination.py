"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows (``window`` consecutive words, or all of a shorter item) are sets of shingles of
``shingle`` words.  A document holds a window only if it holds all its shingles, so the necessary
prefix is one shingle, the rarest.

1. One pass over the documents hashes the shingle at every word.  A bitmap of the items' shingles
   lets nearly none of the others through; it has a bounded size, and where the items outgrow it
   more rows pass, which changes no result.  A position that passes carries the few words around
   it, so the texts are never shuffled.
2. Rarity is the count of a shingle over all documents; each window is joined by its rarest one.
3. Positions give the place where the window would start; it must fit into the text (length and
   position bounds).  Then the words there are compared with the window's words, one by one.

Null and empty texts have no words; such documents are clean, such items are found nowhere.  Items
with equal windows are all reported.  Repeated rows get equal results.  Empty tables are allowed
on either side.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import let
from threatlake.llm.common import lower_ascii, split_words, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

# The shingles of the items are broadcast up to this many (a long each); beyond, both sides of
# that join are shuffled.
BROADCAST_SHINGLES = 1_000_000
_MAX_BITS = 2**20
_BITS_PER_SHINGLE = 64


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def fingerprint(text: Column) -> Column:
    """Tells texts apart that share an id; null differs from empty."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def _shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, win (its words, space joined) and win_words."""
    cut = let(
        words_of(F.col("text")),
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))),
                lambda i: F.slice(w, i, window),
            ),
        ),
    )
    return (
        benchmark.select("item_id", F.explode(cut).alias("win_words"))
        .withColumn("win", F.array_join("win_words", " "))
        .distinct()
    )


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """win, off (the shingle's place in the window), h, k (its words)."""

    def hashes(w: Column, size: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda o: F.struct(
                o.alias("off"), _shingle_hash(w, o, size).alias("h"), F.lit(size).alias("k")
            ),
        )

    chain = F.when(F.size("win_words") >= shingle, hashes(F.col("win_words"), shingle))
    for size in range(1, shingle):
        chain = chain.when(F.size("win_words") == size, hashes(F.col("win_words"), size))
    return windows.select("win", F.explode(chain).alias("s")).select("win", "s.*")


def _bitmap(shingles: DataFrame, bits: int) -> Column:
    """The items' shingles as a literal array of longs, one bit per hash value modulo ``bits``.

    Lambdas take no subqueries and a column would be copied into every row, so the longs (at most
    ``_MAX_BITS`` / 64) go into the plan as one string that is folded to an array.
    """
    at = F.pmod(F.col("h"), F.lit(bits))
    marks = shingles.groupBy(F.shiftright(at, 6).cast("int").alias("id")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {bits}) % 64 as int)))").alias("b")
    )
    cells = dict(marks.collect())
    return F.split(F.lit(",".join(str(cells.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")


def _positions(docs: DataFrame, shingles: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per document with ``pos`` -1, and one per place of a shingle that an item has."""
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())  # at most ``shingle``
    n = shingles.count()
    bits = 64
    while bits < min(_MAX_BITS, n * _BITS_PER_SHINGLE):
        bits *= 2
    here = "array<struct<pos:int,h:bigint,ctx_start:int,ctx:array<string>>>"
    row = F.array(
        F.struct(
            F.lit(-1).alias("pos"),
            F.lit(None).cast("bigint").alias("h"),
            F.lit(None).cast("int").alias("ctx_start"),
            F.lit(None).cast("array<string>").alias("ctx"),
        )
    ).cast(here)

    def marked(bitmap: Column, h: Column) -> Column:
        place = F.pmod(h, F.lit(bits))
        return F.getbit(F.get(bitmap, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1

    def found(w: Column, bitmap: Column, size: int) -> Column:
        all_places = F.when(
            F.size(w) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - size),
                lambda i: F.struct(i.alias("pos"), _shingle_hash(w, i, size).alias("h")),
            ),
        ).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))

        def around(p: Column) -> Column:
            start = F.greatest(p["pos"] - (window - size), F.lit(0))
            return F.struct(
                p["pos"].alias("pos"),
                p["h"].alias("h"),
                start.alias("ctx_start"),
                F.slice(w, start + 1, 2 * window - size).alias("ctx"),
            )

        return F.transform(F.filter(all_places, lambda p: marked(bitmap, p["h"])), around)

    def per_document(w: Column, bitmap: Column) -> Column:
        places = F.concat(row, *[found(w, bitmap, k).cast(here) for k in sizes])
        return F.struct(F.size(w).alias("n_words"), places.alias("places"))

    bitmap = _bitmap(shingles, bits)
    scanned = docs.select(
        "doc_id",
        fingerprint(F.col("text")).alias("fp"),
        let(words_of(F.col("text")), lambda w: let(bitmap, lambda b: per_document(w, b))).alias("d"),
    )
    rows = scanned.select("doc_id", "fp", "d.n_words", F.explode("d.places").alias("p")).select(
        "doc_id", "fp", "n_words", "p.*"
    )
    known = shingles.select("h", F.lit(True).alias("known")).distinct()
    if n <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    joined = rows.join(known, "h", "left").where((F.col("pos") < 0) | F.col("known"))
    return written(joined.drop("known"), "places")


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5):
    """``documents`` (doc_id, fp, n_words; one row each) and ``matches`` (doc_id, fp, start, win)."""
    windows = written(item_windows(benchmark, window), "windows")
    distinct = windows.select("win", "win_words").distinct()
    shingles = written(_window_shingles(distinct, shingle), "shingles")
    places = _positions(docs, shingles, window, shingle)
    documents = places.where(F.col("pos") < 0).select("doc_id", "fp", "n_words")
    hits = places.where(F.col("pos") >= 0)

    counts = hits.groupBy("h").agg(F.count("*").alias("df"))
    rarest = (
        shingles.join(counts, "h", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("r"))
        .where(F.col("r.df") > 0)
        .select("win", "r.h", "r.off")
    )
    prefix = rarest.join(distinct, "win")
    start = F.col("pos") - F.col("off")
    n = F.size("win_words")
    candidates = (
        hits.join(prefix, "h")
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + n <= F.col("n_words")))
    )
    there = F.slice("ctx", F.col("start") - F.col("ctx_start") + 1, n)
    matches = candidates.where(there == F.col("win_words")).select(
        "doc_id", "fp", "start", n.alias("len"), "win"
    )
    return documents, written(matches.distinct(), "matches"), windows.select("item_id", "win")


def _union_length(spans: Column) -> Column:
    """Words under at least one span (start, len)."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

    def step(state: Column, span: Column) -> Column:
        to = span["start"] + span["len"]
        fresh = F.greatest(to - F.greatest(span["start"], state["to"]), F.lit(0))
        return F.struct(F.greatest(to, state["to"]).alias("to"), (state["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per document: doc_id, fp, n_words, n_hit, items (sorted texts of the ids), contaminated."""
    documents, matches, items = find(docs, benchmark, window, shingle)
    words = matches.groupBy("doc_id", "fp").agg(
        _union_length(F.collect_set(F.struct("start", "len"))).alias("n_hit")
    )
    named = (
        matches.select("doc_id", "fp", "win").distinct()
        .join(items, "win")
        .groupBy("doc_id", "fp")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["fp"] == b["fp"])
    found = words.join(named, same(words, named)).select(words["doc_id"], words["fp"], "n_hit", "items")
    none = F.array().cast("array<string>")
    return documents.join(found, same(documents, found), "left").select(
        documents["doc_id"],
        documents["fp"],
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The documents without any window of the benchmark, all columns as they were."""
    _, matches, _ = find(docs, benchmark, window, shingle)
    bad = matches.select("doc_id", "fp").distinct()
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (fingerprint(docs["text"]) == bad["fp"])
    return docs.join(bad, same, "left_anti")
