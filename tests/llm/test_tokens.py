import math
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from driftbasket.llm import id_files, packing, queries, token_counts
from driftbasket.llm.encoding import encode_text
from fixtures import EDGE_TEXTS, edge_docs, empty_docs
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


loaded = lru_cache(Tokenizer.from_file)


def library(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path, texts):
    lib = Tokenizer.from_file(path)
    for t in [*texts.values(), *EDGE_TEXTS, "a\0b", "<|startoftext|>x", "İ Σσ", "  a\n b", "\n \n"]:
        assert encode_text(path, t or "").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_counts(spark, sf_dir, texts):
    lib = Tokenizer.from_file(BYTE)
    got = queries.op5_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)


def test_counts_of_edges(spark):
    docs = edge_docs(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE).collect()))
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(library(BYTE, r.text))) for r in docs.collect())
    assert token_counts.count_tokens(empty_docs(spark), BYTE).count() == 0


@pytest.mark.parametrize("limit", [0, 3, 50])
def test_small_caches_give_the_same_counts(texts, limit):
    lib = Tokenizer.from_file(BYTE)
    sample = [t or "" for t in list(texts.values())[:40]]
    assert token_counts.PieceLengths(BYTE, {}, limit).batch(sample) == [len(x.ids) for x in lib.encode_batch(sample, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = rng.integers(0, 2 ** rng.integers(1, 33, n)).astype(np.uint32)
    control, data = id_files.encode_ranks(ranks)
    assert len(control) == -(-n // 4)
    assert (id_files.decode_ranks(control, data, np.array([n])) == ranks).all()


def check_files(rows, docs, end):
    start = 0
    for r, (doc, text) in zip(rows, docs, strict=True):
        ids = np.array([*library(BYTE, text), end], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files(spark, sf_dir, texts):
    rows = sorted(queries.op7_id_files(spark, sf_dir).collect(), key=lambda r: r.start)
    check_files(rows, sorted(texts.items()), 0)


def test_files_of_edges(spark):
    docs = edge_docs(spark)
    path = id_files.write_ids(docs, BYTE, 0, ids_per_bucket=300, ids_per_block=8)
    rows = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    check_files(rows, sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)), 0)
    assert id_files.read_ids(spark, id_files.write_ids(empty_docs(spark), BYTE, 0)).count() == 0


def test_combinations_fill_the_window():
    c = packing.combinations(12, 3)
    assert (c @ np.arange(1, 13) == 12).all() and c.sum(1).max() <= 3 and len(c) == 19


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12) * 5
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 1e-9]).max() < 1e-6


def check_packing(rows, docs, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    padding = total = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padding += 0 if math.log2(at).is_integer() else window - at
    return by_doc, padding / max(total, 1)


def test_packing(spark, sf_dir, texts):
    by_doc, padding = check_packing(queries.op2_nnls_packing(spark, sf_dir).collect(), texts, 4096)
    assert padding < 0.005
    assert {d for d, _ in by_doc} == set(texts)
    for (doc, n), pieces in by_doc.items():
        ids = np.array([*library(WORD, texts[doc]), 2], "<u4")
        assert n == len(ids)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == n


def test_packing_of_edges(spark):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, WORD, 2, window=64, docs_per_shard=3).collect()
    check_packing(rows, docs, 64)
    assert sum(r.length for r in rows) == sum(len(library(WORD, r.text)) + 1 for r in docs.collect())
    assert packing.pack_documents(empty_docs(spark), WORD, 2).count() == 0
