"""The registered queries over a whole small table, against the libraries and plain Python versions."""

import zlib

import numpy as np
import pytest

from logquarry.llm import merge_dropout
from logquarry.llm.queries import QUERIES
from logquarry.llm.token_counts import pre_tokens
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    from logquarry.llm.bpe import TextEncoder

    return TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_op2(spark, documents, vocabulary):
    sequences, bound = check_packing(QUERIES["op2_best_fit_packing"](spark, SF).collect(), documents, vocabulary, 1024)
    assert sequences <= 1.01 * bound


def test_op8(spark, documents, vocabulary):
    want, start = [], 0
    for doc_id, text in sorted(documents):
        ids = np.array([*vocabulary.library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op8_token_records"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == want


def test_op9(spark, documents, pieces):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op9_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    for doc_id, text in documents:
        n = len(pieces.encode(text))
        assert got[doc_id] == (doc_id, len(text.encode()), n, n > 4096)


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def dropped_out(word, key, limit, pieces):
    """Merge the best pair that is not skipped until there is none, by looking at all pairs each time."""
    cuts = list(range(len(word) + 1))
    while True:
        best = None
        for a, b, c in zip(cuts, cuts[1:], cuts[2:]):
            made = pieces.get(word[a:c])
            if made is None or word[a:b] not in pieces or word[b:c] not in pieces:
                continue
            if mixed(mixed(a << 42 ^ b << 21 ^ c) ^ key) < limit:
                continue
            if best is None or (-made[0], made[1], a) < best[0]:
                best = (-made[0], made[1], a), b
        if best is None:
            return [word[a:b] for a, b in zip(cuts, cuts[1:])]
        cuts.remove(best[1])


def test_op4(spark, documents, pieces):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    normal = {p.piece.replace("▁", " "): (p.score, i) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
    of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
    seed, limit = merge_dropout.SEED, int(merge_dropout.RATE * 2.0**64)
    got = {r["doc_id"]: r for r in QUERIES["op4_merge_dropout"](spark, SF).collect()}
    varied = 0
    for doc_id, text in documents:
        start, nth, ids = mixed(doc_id ^ mixed(seed + 1)), 0, []
        for i, line in enumerate(pre_tokens(text)):
            ids += [of_byte[10]] if i else []
            for word in line:
                key = mixed(mixed((start + nth) & M) ^ mixed(seed))
                nth += 1
                for part in dropped_out(word, key, limit, normal):
                    ids += [normal[part][1]] if part in normal else [of_byte[b] for b in part.encode()]
        row = got[doc_id]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert row["lossless"] and row["n_bytes"] == len(text.encode())
        varied += len(ids) != len(pieces.encode(text))
    assert varied > 0.9 * len(documents)
