"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

from test_operators import EDGE, components_of, near_pairs, repeats, word_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumns({c: F.lit("x") for c in ("score", "kept", "lang_pred", "row")})


def test_language_stage_keeps_documents_with_words(spark, docs, edge):
    import corpus_pipeline as P

    kept = P.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    kept = P.language_stage(spark, edge, SF)
    assert kept.columns == edge.columns and {2, 3, 4, 8}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert P.language_stage(spark, edge.limit(0), SF).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, edge):
    import corpus_pipeline as P

    rows = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    sets = word_sets(rows.items(), 5)
    want = {c for c in components_of(sets, near_pairs(sets)).values()}
    kept = P.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    kept = P.near_duplicate_stage(spark, edge, SF)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8, 9]


def test_repeat_stage_cuts_the_text(spark, docs, edge):
    import corpus_pipeline as P

    for table in (docs, edge):
        cut = P.repeat_stage(spark, table, SF)
        assert cut.columns == table.columns and cut.count() == table.count()
        rows = cut.collect()
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        source = [(r["doc_id"], (r["text"] or "").encode()) for r in table.collect() if r["doc_id"] is not None]
        left = {i: n - gone for i, n, gone, _, _ in repeats(source, 50)}
        assert all(0 <= left[r["doc_id"]] - len(r["text"].encode()) <= 6 * 50 for r in rows if r["doc_id"] is not None)
        assert {r["doc_id"]: r["source"] for r in rows} == {r["doc_id"]: r["source"] for r in table.collect()}


def test_run_applies_all_stages(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "packing"]
    out = P.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
