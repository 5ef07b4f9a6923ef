import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import merge_dropout, packing, token_counts, token_records
from logquarry.llm.bpe import TextEncoder
from logquarry.llm.common import new_path
from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("abcXY 12\n\t\r.,'\"!é▁日😀 \x1c")), max_size=60), max_size=8)


@pytest.fixture(scope="module")
def bpe():
    return TextEncoder(BPE)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoder_gives_the_librarys_ids(bpe, texts):
    texts = [*texts, "it's <|endoftext|> ok", "don't we'll\nx's"]
    want = [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, bpe.dtype).tolist() for x in bpe.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_piece_counts_and_plain_ids_are_the_librarys(pieces, texts):
    want = pieces.encode(texts)
    assert token_counts.piece_counter(PIECES).counts(texts) == list(map(len, want))
    plain = merge_dropout.codec(PIECES, 0.0)
    clean = [t.replace("▁", "") for t in texts]
    got = plain.encode(clean, list(range(len(clean))))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == pieces.encode(clean)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 9))
def test_dropout_is_lossless_and_repeatable(texts, doc):
    code = merge_dropout.codec(PIECES, 0.4)
    ids = code.encode(texts, [doc] * len(texts))
    assert [code.decode(x) for x in ids] == texts
    assert merge_dropout.PieceCodec(PIECES, 0.4).encode(texts, [doc] * len(texts)) == ids


def test_dropout_varies_and_the_agenda_agrees_with_rounds(monkeypatch):
    code = merge_dropout.PieceCodec(PIECES, 0.3)
    words = [" internationalization", " responsibilities", "hello" * 9, "日本語x"] * 4
    variants = np.arange(16) // 4
    rounds = code.segment(words, variants)
    assert len(set(rounds[::4])) > 1
    monkeypatch.setattr(merge_dropout, "LONG", 0)
    assert code.segment(words, variants) == rounds


def test_dropout_over_documents(spark):
    got = merge_dropout.encode_decode(brute.frame(spark), PIECES).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in brute.documents())
    assert all(r["decoded"] == r["text"] for r in got)
    assert merge_dropout.encode_decode(brute.empty(spark), PIECES).count() == 0


def test_counts_over_documents(spark, pieces):
    got = token_counts.token_counts(brute.frame(spark), PIECES).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(pieces.encode(r[1] or ""))) for r in brute.documents())
    assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(brute.empty(spark), PIECES).count() == 0


def _ids(bpe, text, end):
    return np.array([*bpe.library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_records_round_trip(spark, bpe, monkeypatch):
    monkeypatch.setattr(token_records, "SMALL_FILE_BYTES", 10_000)
    path = new_path(spark, "records-test")
    token_records.write_records(brute.frame(spark), BPE, 0, path)
    got = token_records.read_back(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], zlib.crc32(_ids(bpe, r[1], 0).tobytes())) for r in brute.documents())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_records_are_read_by_their_index(spark):
    path = new_path(spark, "records-index")
    token_records.write_records(brute.frame(spark), BPE, 0, path)
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len(brute.documents())
    whole = token_records.read_back(spark, path).collect()
    one = token_records.read_at(spark, path, index.where("record_no % 3 = 1").select("file_no", "offset")).collect()
    assert len(one) == index.where("record_no % 3 = 1").count()
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in one) <= Counter((r["doc_id"], r["ids_crc32"]) for r in whole)


def test_no_records_of_no_documents(spark):
    path = new_path(spark, "records-empty")
    token_records.write_records(brute.empty(spark), BPE, 0, path)
    assert token_records.read_back(spark, path).count() == 0


def test_damage_is_found():
    payload = token_records.pack(7, b"\1\0\2\0", 2)
    data = bytearray(token_records.frame(payload))
    data[-6] ^= 1
    at = [0]

    def read(n):
        at[0] += n
        return bytes(data[at[0] - n : at[0]])

    with pytest.raises(ValueError, match="damaged"):
        token_records.unframe(read)


def check_packing(rows, documents, bpe, size):
    texts = Counter()
    by_place = {}
    for r in rows:
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for own in by_place.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    want = Counter()
    for i, text in documents:
        ids = _ids(bpe, text, 2)
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert texts == want
    return len(by_place), -(-sum(k[3] * n for k, n in want.items()) // size)


def test_packing_over_documents(spark, bpe):
    docs = [(r[0], r[1]) for r in brute.documents()]
    for size in (64, 1024):
        got = packing.pack_documents(brute.frame(spark), BPE, size=size).collect()
        sequences, bound = check_packing(got, docs, bpe, size)
        assert sequences <= 1.15 * bound + 2
    assert packing.pack_documents(brute.empty(spark), BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plans_cover_the_histogram_and_beat_no_bound(histogram):
    made = packing.plan(histogram, 64)
    used = Counter()
    for lengths, n in made:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)
    alone = sum(n for _, n in packing.best_fit(histogram, 64))
    assert sum(n for _, n in made) <= 1.1 * alone + 1


def test_plan_of_a_large_histogram_is_near_the_bound():
    r = np.random.default_rng(3)
    histogram = dict(Counter(r.integers(1, 1025, 40_000).tolist()))
    sequences = sum(n for _, n in packing.plan(histogram, 1024))
    bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
    assert sequences <= 1.003 * bound


def test_most_sequences_come_from_fitted_patterns():
    r = np.random.default_rng(4)
    counts = np.bincount(r.integers(1, 65, 5_000), minlength=65)
    columns = packing.patterns(np.flatnonzero(counts), 64)
    repeats = packing.fit(columns, counts.astype(float), np.ones(65))
    patterned = {tuple(sorted((int(v) for v in c if v), reverse=True)) for c, x in zip(columns, repeats) if x >= 1}
    made = packing.plan({int(k): int(counts[k]) for k in np.flatnonzero(counts)}, 64)
    assert sum(n for lengths, n in made if lengths in patterned) > 0.8 * sum(n for _, n in made)
