from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from logquarry.llm import exact_dedup, near_dedup, substring_dedup
from logquarry.llm.common import connected_components
from logquarry.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"


@given(st.sets(st.integers(0, 2**40)))
def test_rice_codes_round_trip(values):
    own = np.array(sorted(values), np.uint64)
    if len(own):
        assert exact_dedup.rice_decode(exact_dedup.rice_encode(own)).tolist() == own.tolist()


def test_exact_groups(spark):
    rows = [(r[0], r[1]) for r in brute.documents()]
    got = exact_dedup.groups(brute.frame(spark)).collect()
    members = defaultdict(list)
    for i, t in rows:
        members[brute.sha(brute.normal(t))].append(i)
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["sha"]) for r in got) == Counter((i, brute.sha(brute.normal(t))) for i, t in rows)
    for r in got:
        ids = members[r["sha"]]
        least = min((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (least, len(ids))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(members) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_keeps_one_row_a_text_with_its_columns(spark):
    docs = brute.frame(spark)
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    texts = [brute.normal(r["text"]) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({brute.normal(r[1]) for r in brute.documents()})
    assert exact_dedup.dedup(brute.empty(spark)).count() == 0


def test_exact_query(spark):
    assert rows_of_df(QUERIES["op7_exact_dedup"](spark, SF)) == rows_of_sql(SQL["op7_exact_dedup"], SF)


def test_substrings(spark):
    rows = [(r[0], r[1]) for r in brute.documents()]
    for parts in (1, 4):
        got = substring_dedup.substring_dedup(brute.frame(spark, parts=parts)).collect()
        assert Counter(map(tuple, got)) == Counter(brute.removed_words(rows))
    assert substring_dedup.substring_dedup(brute.empty(spark)).count() == 0


def test_substrings_of_a_crowd(spark, monkeypatch):
    """Many documents with one text's passages, in few-row limits; long words whose weak codes would be equal."""
    rows = [(r[0], r[1]) for r in brute.crowd(n=60)]
    monkeypatch.setattr(substring_dedup, "CROWD", 1)
    monkeypatch.setattr(substring_dedup, "REFERENCE_SEGMENTS", 2)
    got = substring_dedup.substring_dedup(brute.frame(spark, brute.crowd(n=60))).collect()
    assert Counter(map(tuple, got)) == Counter(brute.removed_words(rows))


def test_index_deals_spans_evenly_and_by_stretches(monkeypatch):
    """Anchors are least codes, but no block gets more than its share; nor does a task hold more than a stretch."""
    words = np.random.default_rng(3).integers(0, 5_000, (40, 20_000)).astype(str)
    texts = pd.DataFrame({"doc_id": range(40), "text": [" ".join(x).encode() for x in words]})
    monkeypatch.setattr(substring_dedup, "INDEX_BYTES", 1 << 20)
    pieces = pd.concat(substring_dedup._index(32, 4, 13, 7)(iter([texts])))
    pieces = pieces[pieces["kind"] == substring_dedup._SPANS]
    sizes = pieces["blob"].str.len().groupby(pieces["place"]).agg(["sum", "count"])
    assert len(sizes) == 32 and sizes["sum"].max() < 1.3 * sizes["sum"].mean()
    assert sizes["count"].min() >= texts["text"].str.len().sum() // (3 << 20) > 0


def test_substrings_found_across_stretches(spark, monkeypatch):
    """Every batch of three rows is a stretch of its own; an anchor is crowded in some of them only."""
    rows = [*brute.documents(), *brute.crowd(n=60)]
    monkeypatch.setattr(substring_dedup, "INDEX_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = substring_dedup.substring_dedup(brute.frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(map(tuple, got)) == Counter(brute.removed_words([(r[0], r[1]) for r in rows]))


def test_factors_carry_block_and_position_of_equal_words(spark):
    docs = brute.frame(spark).select("doc_id", "text")
    parsed = substring_dedup.parsed_rows(docs, 13, 7)
    words = {r["row"]: r["text"].split() for r in parsed.where("text IS NOT NULL").collect()}
    segments = substring_dedup.segments_of(parsed, 13)
    found = substring_dedup.factored(docs, segments, 13).collect()
    assert found and all(f["length"] >= 13 and f["position"] >= 0 for f in found)
    texts = [(t or "").encode() for _, t in ((r[0], r[1]) for r in brute.documents())]
    for f in found:
        stretch = b" ".join(words[f["row"]][f["start"] : f["start"] + f["length"]])
        assert any(stretch in b" ".join(t.split()) for t in texts)


def test_greedy_factors_are_longest_and_checked_at_boundaries():
    reference = b"a b c d e f x c d e g".split()
    segment = b"a b c d e g h".split()
    chains = [[i for i in range(len(reference)) if reference[i : i + 3] == segment[k : k + 3]] for k in range(5)]
    assert substring_dedup.factors(segment, reference, chains, 3) == [(0, 5, 0), (3, 3, 8)]


def test_substring_query(spark):
    assert rows_of_df(QUERIES["op3_substring_dedup"](spark, SF)) == rows_of_sql(SQL["op3_substring_dedup"], SF)


def test_near_groups(spark):
    rows = [(r[0], r[1]) for r in brute.documents()]
    for words, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_groups(brute.frame(spark), words, percent).collect()
        want = brute.components(rows, words, percent)
        assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(brute.shingles(t, words))) for i, t in rows)
        assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert near_dedup.near_groups(brute.empty(spark)).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = brute.frame(spark)
    got = near_dedup.dedup(docs)
    want = brute.components([(r[0], r[1]) for r in brute.documents()], 5, 80)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_near_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute.components([tuple(r) for r in docs], 3, 85)
    got = QUERIES["op5_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_bands_are_cut_and_lose_no_link(spark, monkeypatch):
    rows = [r for r in brute.documents(5) if r[0] is not None]
    monkeypatch.setattr(near_dedup, "BAND_ROWS", 2)
    monkeypatch.setattr(near_dedup, "VERIFY_ROWS", 2)
    got = near_dedup.near_groups(brute.frame(spark, rows), 3, 85).collect()
    want = brute.components([(r[0], r[1]) for r in rows], 3, 85)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_a_crowd_of_near_copies_loses_no_link(spark, monkeypatch):
    """Similarities lie on both sides of the thresholds; the last two texts have long words that differ everywhere."""
    rows = brute.crowd()
    for words, percent, size in ((3, 85, 512), (3, 85, 16), (5, 80, 40)):
        monkeypatch.setattr(near_dedup, "BAND_ROWS", size)
        got = near_dedup.near_groups(brute.frame(spark, rows), words, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute.components([(r[0], r[1]) for r in rows], words, percent)


def test_sequential_pruning_keeps_pairs_at_the_threshold():
    seen, least = map(np.array, zip(*near_dedup.prune_below(0.85)))
    assert seen[-1] == near_dedup.HASHES and (np.diff(least) > 0).all()
    assert (least < 0.85 * seen).all() and least[-1] > 0.6 * near_dedup.HASHES
    assert near_dedup.band_shape(0.85, near_dedup.HASHES) == (5, 25)
    for hashes in (near_dedup.HASHES, near_dedup.STRICT_HASHES):
        for threshold in (0.5, 0.8, 0.85, 0.95):
            rows, bands = near_dedup.band_shape(threshold, hashes)
            assert rows * bands <= hashes and (1 - threshold**rows) ** bands <= near_dedup.MISS_BAND


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 50), (70, 50), (100, 101), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(31)} | {(i, 50) for i in (50, 70, 100, 101)}
