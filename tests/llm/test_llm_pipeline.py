"""The pipeline's stages against plain versions, each on its own input."""

import llm_brute as brute
import corpus_pipeline

from panelkit.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        pairs = [(r.doc_id, r.text) for r in rows]
        out = stage(spark, docs, SMALL).cache()
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in pairs}
            break
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert len(got) == out.count()
        if name == "quality rules":
            want = {q[0] for q in brute.quality([(r.doc_id, r.text, r.source) for r in rows],
                                                quality.MAX_DOCS_PER_HOST, quality.MIN_REMAINING_PERCENT) if q[7]}
            assert set(got) == want
        elif name == "line dedup":
            left = brute.line_dedup(pairs)
            assert got == {d: left[d, t][2] for d, t in pairs if brute.words(left[d, t][2]) or not left[d, t][1]}
        elif name == "n-gram Jaccard join":
            assert set(got) == {c for _, _, c in brute.near_duplicates(pairs)}
        else:
            assert set(got) == {d for d, _, hit, _, _ in brute.contamination(pairs, bench) if not hit}
        docs = out


def test_run_reads_and_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and "sequence_id" in out.columns
