import corpus_pipeline
from tests.llm import brute
from tests.llm.test_search_quality_secrets import brute_spans


def test_stages_against_plain_versions(spark):
    """Each stage on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = [tuple(r) for r in docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        new = [tuple(r) for r in got.collect()]
        texts = {r[0]: r[1] for r in rows}
        if i == 0:
            bad = [k for k, v in labels.items() if v == 0]
            assert {r[0] for r in new}.isdisjoint(bad)
            assert {r[0] for r in new} >= {k for k, v in labels.items() if v == 1}
        elif i == 1:
            first = {}
            for k in sorted(texts):
                first.setdefault(brute.normal(texts[k]), k)
            assert {r[0] for r in new} == set(first.values())
        elif i == 2:
            assert {r[0] for r in new} == {k for k, c in brute.components(list(texts.items()), 5, 80).items() if k == c}
        else:
            assert {r[0] for r in new} == set(texts)
            assert all(r[1] == texts[r[0]] for r in new if not brute_spans(texts[r[0]]))
            assert not any("token = \"" + "0" in r[1] for r in new)
        docs, rows = spark.createDataFrame(new, docs.schema), new
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (brute.documents(), []):
        docs = brute.frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns
            docs = spark.createDataFrame([tuple(r) for r in got.collect()], docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
