"""Texts of over 1 MiB, and columns with the names that operators use themselves."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from logquarry.llm import exact_dedup, packing, secret_scans, token_counts, token_records
from logquarry.llm.bpe import TextEncoder
from logquarry.llm.common import new_path
from tests.llm import brute
from tests.llm.test_tokens import check_packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return TextEncoder(BPE)


def test_packing(spark, bpe):
    rows, docs = brute.odd_documents(spark)
    check_packing(packing.pack_documents(docs, BPE).collect(), [r[:2] for r in rows], bpe, 1024)


def test_records(spark, bpe):
    rows, docs = brute.odd_documents(spark)
    path = new_path(spark, "records-long")
    token_records.write_records(docs, BPE, 0, path)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_records.read_back(spark, path).collect())
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*bpe.library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got == want


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows, docs = brute.odd_documents(spark)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, PIECES).collect())
    assert got == Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows)


def test_exact_groups(spark):
    rows, docs = brute.odd_documents(spark)
    sizes = Counter(brute.normal(t) for _, t, *_ in rows)
    got = Counter((r["doc_id"], r["group_size"], r["sha"]) for r in exact_dedup.groups(docs).collect())
    assert got == Counter((i, sizes[brute.normal(t)], brute.sha(brute.normal(t))) for i, t, *_ in rows)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)
    first = {}
    for i, t, *_ in rows:
        name = brute.normal(t)
        first[name] = min(first.get(name, (True, 0)), (i is None, i or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == Counter(first.values())


def test_secrets_stay_out_of_long_texts(spark):
    rows, docs = brute.odd_documents(spark)
    redacted = secret_scans.redact(docs)
    assert redacted.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in redacted.where("doc_id >= 9000").collect()}
    assert got == {i: t for i, t, *_ in rows if i is not None and i >= 9000}
