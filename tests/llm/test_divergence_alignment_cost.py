"""Operators 11 to 13 against brute force, and their queries over a whole small table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import alignment, cost_packing, divergence
from logquarry.llm.bpe import TextEncoder
from logquarry.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("abcXY 12\n\t\r.,'\"!é▁日😀 \x1c\x00")), max_size=60), max_size=8)


@pytest.fixture(scope="module")
def bpe():
    return TextEncoder(BPE)


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(BPE, PIECES)


# --- operator 11


def brute_audit(rows, min_docs, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [(s, w) for g, s, w in words if g == lang]
        in_docs, counts = Counter(), defaultdict(Counter)
        for s, w in own:
            in_docs.update(set(w))
            counts[s].update(w)
        kept = [t for t, n in in_docs.items() if n >= min_docs]
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (n + v) for t in kept}

        of = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s, p in of.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, o in of.items() if x != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("block, terms, entries, slab", [(16, 8192, 200_000, 64), (2, 7, 11, 2), (3, 50, 1000, 1)])
def test_audit_equals_brute_force(spark, block, terms, entries, slab):
    r = random.Random(4)
    rows = [(*row[:2], r.choice(["en", "de", None]), r.choice(["a", "b", "é", None, "d", "e", "f"]), *row[4:]) for row in brute.documents()]
    rows += [(1, "alone", "xx", "only", 1, "x", 7, "c"), (2, None, "yy", "p", 1, "x", 7, "c"), (3, "12 34", "yy", "q", 1, "x", 7, "c")]
    got = divergence.audit(brute.frame(spark, rows), 2, 20, block, terms, entries, slab).collect()
    assert sorted(tuple(x) for x in got) == brute_audit(rows, 2, 20)


def test_audit_of_odd_documents_and_of_none(spark):
    rows, docs = brute.odd_documents(spark)
    got = divergence.audit(docs).collect()
    assert sorted(tuple(x) for x in got) == brute_audit(rows, 3, 200)
    assert divergence.audit(brute.empty(spark)).collect() == []


def test_shares_do_not_overflow():
    n = np.array([0, 1, 10**12, 5 * 10**14])
    assert divergence.shares(n, 10**15 + 7).tolist() == [1 + 10**9 * (x + 1) // (10**15 + 7) for x in n.tolist()]


def test_op11(spark):
    assert rows_of_df(QUERIES["op11_divergence_audit"](spark, SF)) == rows_of_sql(SQL["op11_divergence_audit"], SF)


# --- operator 12


def brute_alignment(both, rows):
    """By the libraries over whole texts and a walk over bytes."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    counts, found = Counter(), []
    for i, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(both.bytes_a[t] for t in a) != want or b"".join(both.bytes_b[t] for t in b) != want:
            found.append((i, 0, 0, 0, [], ""))
            continue
        links, groups, now_a, now_b = [], [], [str(a[0])], [str(b[0])]
        x = y = 0
        end_x, end_y = len(both.bytes_a[a[0]]), len(both.bytes_b[b[0]])
        while True:
            links.append((a[x], b[y]))
            step_x, step_y = end_x <= end_y, end_y <= end_x
            if step_x and step_y:
                groups.append(",".join(now_a) + "|" + ",".join(now_b))
                now_a, now_b = [], []
            if step_x:
                x += 1
            if step_y:
                y += 1
            if x == len(a):
                break
            if step_x:
                end_x += len(both.bytes_a[a[x]])
                now_a.append(str(a[x]))
            if step_y:
                end_y += len(both.bytes_b[b[y]])
                now_b.append(str(b[y]))
        counts.update(links)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, na, nb, ng, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest)
        for i, na, nb, ng, links, digest in found
    ]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_units_give_the_libraries_tokens(both, texts):
    texts = [t for t in [*texts, "it's <|endoftext|> ok", "a\nb c\n\nd", "\nfoo", " \nfoo ", "<0x41> </s>"] if t]
    for text, row in zip(texts, brute_alignment(both, list(enumerate(texts)))):
        numbers = both.numbers(both.units(text))
        stats = both.stats[numbers]
        if row[7]:
            assert stats[:, :4].sum(axis=0).tolist() == list(row[1:5])
            assert hashlib.sha256(";".join(both.groups[i] for i in numbers).encode()).hexdigest() == row[7]
        else:
            assert not stats[:, 4].all()


@pytest.mark.parametrize("buckets, task_postings", [(32, 8_000_000), (5, 300)])
def test_alignment_equals_brute_force(spark, both, buckets, task_postings):
    rows, docs = brute.odd_documents(spark)
    got = alignment.align(docs, BPE, PIECES, buckets, task_postings).collect()
    assert in_order(got) == in_order(brute_alignment(both, [r[:2] for r in rows]))


def test_alignment_of_none(spark):
    assert alignment.align(brute.empty(spark), BPE, PIECES).collect() == []


def test_the_memo_forgets(both, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 20)
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(3)) + f" w{i} the the of" for i in range(60)]
    both.clear()
    want = brute_alignment(both, list(enumerate(texts)))
    for text, row in zip(texts, want):
        numbers = both.numbers(both.units(text))
        assert both.stats[numbers, :4].sum(axis=0).tolist() == list(row[1:5])
    assert len(both.known) < 60


def test_op12(spark, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert in_order(QUERIES["op12_alignment"](spark, SF).collect()) == in_order(brute_alignment(both, rows))


# --- operator 13


def check_cost_packing(rows, documents, bpe, size):
    """Pieces cover each document, sequences have no gap and no padding; gives how many pieces and sequences there are."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    left = {k: Counter(v) for k, v in pieces.items()}
    for i, text in documents:
        ids = np.array([*bpe.library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = left[i, len(ids)], 0
        while at < len(ids):
            nxt = next(p for p in own if p[0] == at and own[p] and p[2] == zlib.crc32(ids[at : at + p[1]].tobytes()))
            own[nxt] -= 1
            at += nxt[1]
        assert at == len(ids)
    assert not any(n for own in left.values() for n in own.values())
    return len(rows), len(sequences)


@pytest.mark.parametrize("size, run_rows", [(1024, 5_000), (64, 3)])
def test_cost_packing_of_odd_documents(spark, bpe, size, run_rows):
    rows, docs = brute.odd_documents(spark)
    got = cost_packing.pack_documents(docs, BPE, size=size, run_rows=run_rows).collect()
    check_cost_packing(got, [r[:2] for r in rows], bpe, size)


def test_cost_packing_of_none(spark):
    assert cost_packing.pack_documents(brute.empty(spark), BPE).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plan_fills_sequences_and_balances_cost(histogram):
    parts = cost_packing.plan(histogram, 64, linear=100)
    filled, covered = defaultdict(list), defaultdict(Counter)
    for p in parts:
        for k in range(p.count):
            filled[p.sequence + k].append((p.offset, p.length))
            covered[p.original, p.ordinal + k].update(range(p.start, p.start + p.length))
    assert covered.keys() == {(n, k) for n, count in histogram.items() for k in range(count)}
    assert all(c == Counter(range(n)) for (n, _), c in covered.items())
    tokens = sum(n * count for n, count in histogram.items())
    assert sorted(sum(n for _, n in own) for own in filled.values()) == sorted(c for c, n in cost_packing.capacities(tokens, 64) for _ in range(n))


def test_pieces_go_to_the_cheapest_sequence_with_room():
    parts = cost_packing.plan({10: 2, 6: 4, 2: 4}, 16, linear=1)
    assert [(p.length, p.sequence, p.count) for p in parts if p.original == 10] == [(10, 0, 2)]
    assert parts[1].original == 6 and parts[1].sequence == 2  # the third, still free, costs nothing yet
    assert sum(p.count for p in parts) == 10  # nothing is cut


def test_op13(spark, bpe):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces, _ = check_cost_packing(QUERIES["op13_cost_packing"](spark, SF).collect(), rows, bpe, 1024)
    least = sum(-(-len(bpe.library.encode(t or "", add_special_tokens=False).ids) // 1024) for _, t in rows)
    assert pieces < 1.5 * least
