"""Language identification with string kernels.

The kernel of two texts is the number of letter n-grams (one to ``SPECTRUM`` long, presence only)
that both have, over the root of the product of how many each has.  A few landmark texts span the
feature space (Nyström), and one ridge regression per language, trained against the rest, gives a
weight per landmark.  Texts are scored in batches: the presence matrix times the landmarks' matrix
gives the kernel values, and these times the weights the scores.

Letters a to z have classes of their own, other letters share classes by code point; runs of
anything else are one separator.  A text is read piece by piece, whole, in memory that its length
does not change.

Training takes at most ``PER_LANGUAGE`` labelled documents of each language, and fewer where more
than ``TRAINING_ROWS`` would come together, but one at least: every language is learned.  They are
chosen by a hash of doc_id; nothing else is bounded.

A score says which language a text is nearest to, not whether it is near: a text that shares nothing
with the landmarks scores one half.  So ``keep_identified`` also asks how many of a text's n-grams
the landmarks know at all.  Each language's cut is ``SLACK`` times the least share among its training
documents that the model gets right, a landmark being judged by the others.  The slack is for
documents not trained on.

``lang_pred`` is a learned language, or ``und`` for a null text, a text without letters, and
everything where there was nothing to learn from; ties go to the first language in order of name.
``score`` is 0 to 1.  Repeated rows get equal results; an empty table gives no rows.  Columns named
lang_pred or score are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from threatlake.llm.common import sliced

SPECTRUM = 3
PER_LANGUAGE = 400
TRAINING_ROWS = 80_000
LANDMARKS = 128
RIDGE = 1e-3
SLACK = 2 / 3
UNKNOWN = "und"

_CLASSES = 64
_PIECE = 1 << 20
_BATCH = 256
_OFFSETS = [sum(_CLASSES**k for k in range(1, n)) for n in range(1, SPECTRUM + 1)]
_SIZE = _OFFSETS[-1] + _CLASSES**SPECTRUM


def _class_table() -> np.ndarray:
    """Class of every code point of the basic plane; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % (_CLASSES - 27)
    return table


_table: list[np.ndarray] = []
_flags = np.zeros(_SIZE, bool)


def _classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = _table[0][np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        out[at] = 27 + points[at] % (_CLASSES - 27) if chr(points[at]).isalpha() else 0
    return out


def ngrams(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams a text has; none if it has no letter."""
    flags, tail, lettered = _flags, np.zeros(1, np.int32), False
    text = text or ""
    for start in range(0, len(text), _PIECE):
        found = _classes(text[start : start + _PIECE])
        lettered = lettered or bool(found.any())
        run = np.concatenate([tail, found.astype(np.int32)])
        if start + _PIECE >= len(text):
            run = np.append(run, 0)
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != 0) | (run[:-1] != 0)
        run = run[keep]
        code = run
        for n, offset in enumerate(_OFFSETS, 1):
            if n > 1:
                code = code[:-1] * _CLASSES + run[n - 1 :]
            flags[code + offset] = True
        tail = run[-(SPECTRUM - 1) :]
    present = np.flatnonzero(flags)
    flags[present] = False
    return present.astype(np.int32) if lettered else np.zeros(0, np.int32)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks
    place: np.ndarray  # n-gram to its row, or -1
    landmarks: np.ndarray  # presence (vocabulary x landmarks) over the root of their sizes
    weights: np.ndarray  # landmarks x languages
    least_known: np.ndarray  # share of known n-grams that a text of each language must have

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for i, own in enumerate(texts):
            at = self.place[own]
            rows[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(own)))
        return rows @ self.landmarks

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel(texts) @ self.weights

    def alike(self, texts: list[np.ndarray], best: np.ndarray) -> list[bool]:
        """Whether the landmarks know as many of a text's n-grams as its language asks for."""
        known = [np.count_nonzero(self.place[own] >= 0) / max(1, len(own)) for own in texts]
        return [bool(k) and k >= self.least_known[b] for k, b in zip(known, best, strict=True)]


def train(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit from (language, n-grams) pairs in a fixed order; None if there are none."""
    samples = [(lang, own) for lang, own in samples if len(own)]
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    each = max(1, landmarks // len(languages))
    number = {name: k for k, name in enumerate(languages)}
    labels = np.array([number[lang] for lang, _ in samples])
    firsts: list[list[int]] = [[] for _ in languages]
    for i, k in enumerate(labels):
        if len(firsts[k]) < each:
            firsts[k].append(i)
    at = [i for own in firsts for i in own]
    chosen = [samples[i][1] for i in at]
    vocabulary = np.unique(np.concatenate(chosen))
    place = np.full(_SIZE, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    matrix = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, own in enumerate(chosen):
        matrix[place[own], j] = 1 / np.sqrt(len(own))
    none = np.zeros((len(chosen), len(languages)), np.float32)
    model = Model(languages, vocabulary, place, matrix, none, np.zeros(len(languages)))
    own_kernel = (matrix.T @ matrix).astype(np.float64)
    against = np.concatenate(
        [model.kernel([o for _, o in samples[i : i + _BATCH]]) for i in range(0, len(samples), _BATCH)]
    ).astype(np.float64)
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (len(samples) / np.bincount(labels, minlength=len(languages)))[labels][:, None]
    left = against.T @ (balance * against) + ridge * len(samples) * own_kernel
    left += 1e-8 * np.trace(left) * np.eye(len(left))
    model.weights = np.linalg.solve(left, against.T @ (balance * target)).astype(np.float32)
    right = (against @ model.weights).argmax(axis=1) == labels
    held, is_landmark = np.count_nonzero(matrix, axis=1), set(at)
    least = np.full(len(languages), np.inf)
    for i in np.flatnonzero(right):
        rows = place[samples[i][1]]
        # A landmark counts by what the others know of it.
        known = np.count_nonzero(held[rows[rows >= 0]] > (i in is_landmark)) / len(rows)
        least[labels[i]] = min(least[labels[i]], known)
    model.least_known = np.where(np.isfinite(least), SLACK * least, 0.0)
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Train on the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, TRAINING_ROWS // len(counts)))
    # About twice as many as are needed pass the hash, and so many more that no language is missed;
    # the rank then cuts at the exact number.
    passing = max(2 * per_language, per_language + 50)
    share = [(r["lang"], min(1.0, passing / r["count"])) for r in counts]
    shares = F.broadcast(spark.createDataFrame(share, "lang string, share double"))
    order = F.xxhash64("doc_id", "text")
    picked = labelled.join(shares, "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t) for t in batch.column(2).to_pylist()]
            grams = pa.array(found, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), grams], ["lang", "h", "grams"])

    seen = picked.select("lang", order.alias("h"), "text").mapInArrow(read, "lang string, h bigint, grams array<int>")
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    rows = ranked.where(F.col("rank") <= per_language).orderBy("lang", "h").collect()
    return train([(r["lang"], np.array(r["grams"], np.int32)) for r in rows], landmarks)


def predict(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with lang_pred and score."""
    kept = [c for c in columns or docs.columns if c not in ("lang_pred", "score")]
    return _predicted(docs, model, kept)


def _predicted(
    docs: DataFrame, model: Model | None, kept: list[str], with_alike: bool = False, row_text: int | None = None
) -> DataFrame:
    """With ``row_text`` the only column is the whole row, and that is the place of its text."""
    schema = StructType([docs.schema[c] for c in kept]).add("lang_pred", StringType()).add("score", DoubleType())
    if with_alike:
        schema = schema.add("alike", BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in sliced(batches, 4 * _BATCH):
            names, scores, alike = [], [], []
            # The text goes to the worker once: inside its row, or as the last column.
            texts = batch.column(0).field(row_text) if row_text is not None else batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, _BATCH):
                own = [ngrams(t) for t in texts.slice(start, _BATCH).to_pylist()]
                if fitted is None:
                    names += [UNKNOWN] * len(own)
                    scores += [0.0] * len(own)
                    alike += [False] * len(own)
                    continue
                values = fitted.scores(own)
                best = values.argmax(axis=1)
                top = np.clip((values[np.arange(len(own)), best] + 1) / 2, 0, 1)
                names += [fitted.languages[b] if len(g) else UNKNOWN for b, g in zip(best, own, strict=True)]
                scores += [float(s) if len(g) else 0.0 for s, g in zip(top, own, strict=True)]
                alike += fitted.alike(own, best) if with_alike else []
            given = batch.columns if row_text is not None else batch.columns[:-1]
            columns = [*given, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            columns += [pa.array(alike, pa.bool_())] * with_alike
            yield pa.record_batch(columns, schema.names)

    return docs.select(*kept, *([] if row_text else [F.col("text").alias("_text")])).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, min_score: float = 0.25, languages: list[str] | None = None) -> DataFrame:
    """The documents whose language is known, with all their columns.

    Rejected are ``und``, scores below ``min_score``, texts unlike those of their predicted language
    and, if given, languages outside the list.
    """
    model = fit(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    found = _predicted(rows, model, ["_row"], with_alike=True, row_text=docs.columns.index("text"))
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & F.col("alike")
    if languages is not None:
        keep &= F.col("lang_pred").isin(languages)
    return found.where(keep).select("_row.*")
