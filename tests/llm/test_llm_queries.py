"""The registered queries against their SQL, and the others against plain versions."""

import zlib

import compare
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import samples
from threatlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    found = compare.difference(con, spark, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert found is None, found


def texts(sf_dir):
    sql = f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id"
    return duckdb.connect().execute(sql).fetchall()


def encoded(sf_dir, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    rows = texts(sf_dir)
    found = tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [(d, [*e.ids, end]) for (d, _), e in zip(rows, found, strict=True)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_equal_the_library(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_token_files(spark, sf_dir).collect()}
    at = 0
    for doc_id, ids in encoded(sf_dir, "word_bpe_49k.json", 2):
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_packing_keeps_all_tokens_and_is_tight(spark, sf_dir):
    rows = queries.op2_packing(spark, sf_dir).collect()
    ids = dict(encoded(sf_dir, "byte_bpe_50k.json", 0))
    pieces, sequences = {}, {}
    for r in rows:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids[doc_id])
        assert all(r.length == 2048 for r in own[1:])
        assert len(own) == -(-len(ids[doc_id]) // 2048)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_language_of_held_out_documents(spark, sf_dir):
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = [r for r in queries.op3_language_id(spark, sf_dir).collect()]
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_components_equal_all_pairs(spark, sf_dir):
    rows = texts(sf_dir)
    expected = samples.jaccard_components(rows, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, sf_dir).collect()}
    assert got == {rows[i][0]: found for i, found in expected.items()}


def test_shards_are_gapless_and_only_grow(spark, sf_dir):
    rows = queries.op4_sharding(spark, sf_dir).collect()
    truth = dict(texts(sf_dir))
    slots = {}
    for r in rows:
        raw = (truth[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(truth)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def jump(doc_id, shards):
    import hashlib

    key = int(hashlib.md5(str(doc_id).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b
