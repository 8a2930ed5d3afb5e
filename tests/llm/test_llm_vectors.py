"""Vector codes, centroid clustering and sentence pieces against plain versions and the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from llm import samples
from threatlake.llm import centroid_clustering, queries, sentence_pieces, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string, cluster string, v string, length string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def vectors(n, dims, seed=1):
    r = random.Random(seed)
    centers = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [[c + r.gauss(0, 0.2) for c in centers[i % 5]] for i in range(n)]


def table(spark, dims):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(90, dims))]
    rows += [(200 + i, rows[7][1], 1) for i in range(40)]
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.5] * (dims + 1)]
    rows += [(300 + i, v, 9) for i, v in enumerate(odd)]
    rows += [rows[3], (None, rows[4][1], 2)]
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], VECTORS).repartition(3)


def plain(table, dims):
    rows = [r for r in table.collect() if r.embedding is not None and len(r.embedding) == dims]
    rows = [r for r in rows if all(x is not None and np.isfinite(x) for x in r.embedding)]
    return rows, np.floor(np.array([r.embedding for r in rows], float) * 256).astype(np.int64)


def moved(points, books, rounds):
    for _ in range(rounds + 1):
        gap = ((points[:, None] - books[None]) ** 2).sum(axis=2)
        own = gap.argmin(axis=1)
        last = books
        books = np.array([points[own == k].sum(axis=0) // max(1, (own == k).sum()) if (own == k).any() else b for k, b in enumerate(books)])
    return own, gap.min(axis=1), last


def test_clustering_equals_plain_version(spark):
    given_rows = table(spark, 6)
    rows, points = plain(given_rows, 6)
    key = [(r.vec_id is None, hashlib.sha256(f"2:{r.vec_id}".encode()).hexdigest(), *p) for r, p in zip(rows, points, strict=True)]
    first = sorted(range(len(rows)), key=key.__getitem__)[:7]
    own, gap, last = moved(points, points[first], 3)
    found = centroid_clustering.cluster(given_rows, clusters=7, rounds=3, dims=6)
    assert found.centroids == last.tolist()
    expected = [(str(r.vec_id), int(k), int(d), int(gap[own == k].sum()), int(gap.sum())) for r, k, d in zip(rows, own, gap, strict=True)]
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in found.rows().collect())
    assert got == sorted(expected)


@pytest.mark.parametrize("entries", [1, 9, 64, 256])
def test_codes_equal_plain_version(spark, entries):
    given_rows = table(spark, 12)
    rows, points = plain(given_rows, 12)
    order = sorted(range(len(rows)), key=lambda i: (rows[i].vec_id is None, rows[i].vec_id or 0, *points[i]))
    found = vector_codes.encode(given_rows, parts=4, entries=entries)
    codes, errors = [""] * len(rows), np.zeros(len(rows), np.int64)
    for p in range(4):
        part = points[:, 3 * p : 3 * p + 3]
        own, gap, last = moved(part, part[order[:entries]], 2)
        assert found.codebooks[p].tolist() == last.tolist()
        codes = [c + f"{k:02x}" for c, k in zip(codes, own, strict=True)]
        errors += gap
    labels = {}
    for r, e in zip(rows, errors, strict=True):
        labels[r.label] = labels.get(r.label, 0) + e
    expected = [(str(r.vec_id), str(r.label), c, e, labels[r.label]) for r, c, e in zip(rows, codes, errors, strict=True)]
    expected = [(*head, int(e), int(label)) for *head, e, label in expected]
    # Vectors of another length have a row without a code.
    expected += [(i, "9", None, None, None) for i in ("301", "305")]
    got = [(str(r.vec_id), str(r.label), r.code, r.error, r.label_error) for r in found.with_label_error().collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_label_errors_without_broadcast(spark, monkeypatch):
    found = vector_codes.encode(table(spark, 12), parts=4, entries=9)
    some = {tuple(r) for r in found.with_label_error().collect()}
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert {tuple(r) for r in found.with_label_error().collect()} == some


@given(st.integers(1, 400), st.integers(1, 40), st.integers(0, 3), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_tree_assigns_like_all_pairs(n, k, spread, seed):
    r = np.random.default_rng(seed)
    # Few different values give ties, equal entries and balls of one point.
    points = r.integers(-3 * 10**spread, 3 * 10**spread, (n, 4))
    books = r.integers(-3 * 10**spread, 3 * 10**spread, (k, 2))
    trees, roots = vector_codes.forest(points, 2)
    assert all((trees.high - trees.low)[root] == n for root in roots)
    entry = np.full(2 * n, -1)
    sums = np.zeros((2 * k, 2), np.int64)
    both = np.concatenate([books, books])
    for own in vector_codes.assign(trees, roots, both):
        for low, high, e in zip(own.low, own.high, own.entry, strict=True):
            assert (entry[low:high] == -1).all()
            entry[low:high] = e
        np.add.at(sums, own.entry, own.sums)
    for p in range(2):
        part = points[:, 2 * p : 2 * p + 2]
        best = ((part[:, None] - books[None]) ** 2).sum(axis=2).argmin(axis=1)
        own = slice(p * n, (p + 1) * n)
        assert (entry[own] == best[trees.source[own]] + p * k).all()
        assert (sums[p * k : (p + 1) * k] == [part[best == e].sum(axis=0) for e in range(k)]).all()


def test_vectors_too_large_end_the_job(spark):
    big = spark.createDataFrame([(1, [1e30] * 4, 0)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(big, parts=2)
    with pytest.raises(Exception, match="too large"):
        centroid_clustering.cluster(big, dims=4)


def test_vectors_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.encode(empty).with_label_error().count() == 0
    assert centroid_clustering.cluster(empty).rows().count() == 0


# --- sentence pieces ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.Vocabulary(PIECES, memo_segments=50)


def same(vocabulary, texts):
    expected = vocabulary.library.encode(texts, num_threads=1)
    assert [ids.tolist() for ids in vocabulary.encode(texts)] == expected
    assert [vocabulary._merged_long(t) for t in texts] == [vocabulary._merged_short(t) for t in texts]


@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab <>/s▁\n\t é😀0x日the", max_size=60)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_pieces_equal_the_library(vocabulary, texts):
    same(vocabulary, texts)


def test_pieces_of_odd_texts(vocabulary):
    same(vocabulary, ["", " ", "  ", "a ", "▁", "</s> x</s>", "<0x41>", "<unk>", "\x00", " " * 70, "ab" * 40, "é日本語　ﬁ"])


def test_long_text_without_spaces(vocabulary):
    text = samples.words(8000, 3).replace(" ", "")
    assert vocabulary.encode([text])[0].tolist() == vocabulary.library.encode(text)


def test_difference_from_the_library_is_an_error():
    own = sentence_pieces.Vocabulary(PIECES)
    del own.ranks["▁that"]
    with pytest.raises(ValueError, match="library"):
        own.encode(["that the other"])


def test_words_are_remembered():
    """A worker's share of invented words is more than a quarter of a million."""
    own = sentence_pieces.Vocabulary(PIECES)
    own._words = dict.fromkeys(range(500_000), b"")
    own.encode(["the other"])
    assert len(own._words) > 500_000


def test_documents_to_pieces_and_back(spark):
    docs = spark.createDataFrame(samples.documents(), samples.DOCUMENTS).withColumnRenamed("pos", "ids").withColumnRenamed("token", "decoded")
    got = sentence_pieces.encode_documents(docs, PIECES)
    assert sorted(got.columns) == sorted(docs.columns)
    library = sentence_pieces.Vocabulary(PIECES).library
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert r.ids == ids
        assert r.decoded == library.decode(ids)
    assert sentence_pieces.encode_documents(docs.limit(0), PIECES).count() == 0


def test_query_digests(spark, sf_dir):
    library = sentence_pieces.Vocabulary(PIECES).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_sentence_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
