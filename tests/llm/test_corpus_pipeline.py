import random

import corpus_pipeline
from ledgerline.llm import exact_dedup, near_dedup, pii, quality_rules
from ledgerline.llm.staging import read


def test_stages_against_brute_force(spark, data):
    """Each stage on what its predecessor kept."""
    from test_near_dedup import brute as near_brute

    docs = read(spark, data, "documents")
    columns = docs.columns
    rated = {r.doc_id for r in quality_rules.rate(docs).collect() if r.kept}
    kept = corpus_pipeline.quality(spark, docs, data)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(rows) == rated
    best = {}
    for r in rows.values():
        key = r.text.translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
        best[key] = max(best.get(key, -1), r.doc_id)
    stored = spark.createDataFrame(list(rows.values()), docs.schema)
    single = corpus_pipeline.exact(spark, stored, data)
    rows = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and set(rows) == set(best.values())
    stored = spark.createDataFrame(list(rows.values()), docs.schema)
    alone = corpus_pipeline.near(spark, stored, data)
    left = {r.doc_id: r for r in alone.collect()}
    expected = near_brute({k: r.text for k, r in rows.items()}, words=5, percent=80)
    assert alone.columns == columns and set(left) == {k for k, (_, _, kept) in expected.items() if kept}
    stored = spark.createDataFrame(list(left.values()), docs.schema)
    masked = corpus_pipeline.private(spark, stored, data)
    assert masked.columns == columns
    for r in masked.collect():
        assert not pii.base_spans(r.text) and r.lang == left[r.doc_id].lang
        if not pii.base_spans(left[r.doc_id].text):
            assert r.text == left[r.doc_id].text
    pieces = corpus_pipeline.pack(spark, spark.createDataFrame(masked.collect(), docs.schema), data).collect()
    assert {r.doc_id for r in pieces} == set(left)


def test_run_gives_the_last_stage(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "private", "pack"]


def test_stages_take_anything(spark, data):
    """Null ids and texts, repeated rows, long texts, clashing names, empty tables."""
    prose = read(spark, data, "documents").join(quality_rules.rate(read(spark, data, "documents")).filter("kept").select("doc_id"), "doc_id").orderBy("doc_id").limit(3).collect()
    texts = [r.text for r in prose]
    rows = [(1, None), (2, ""), (None, None), (None, texts[0]), (3, texts[0]), (3, texts[0]), (4, texts[1] + " mail a@b.example"), (None, texts[2]), (None, texts[2]), (5, " ".join(texts[1:] * 40)), (6, " \n ")]
    docs = spark.createDataFrame([(k, t, None, "s", len(t or ""), "digest", "key") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, key string")
    good = corpus_pipeline.quality(spark, docs, data)
    assert good.columns == docs.columns and {r.text for r in good.collect()} <= {t for _, t in rows[3:]} and good.filter("doc_id = 3").count() == 2
    single = corpus_pipeline.exact(spark, docs, data)
    kept = sorted(((r.doc_id, (r.text or "")[:9]) for r in single.collect()), key=repr)
    assert single.columns == docs.columns
    assert kept == sorted([(2, ""), (3, texts[0][:9]), (4, texts[1][:9]), (None, texts[2][:9]), (5, texts[1][:9]), (6, " \n ")], key=repr)
    alone = corpus_pipeline.near(spark, docs, data)
    assert alone.columns == docs.columns
    assert sorted((r.doc_id for r in alone.collect()), key=repr) == sorted([1, 2, None, 3, 4, None, 5, 6], key=repr)
    masked = corpus_pipeline.private(spark, docs, data)
    assert masked.columns == docs.columns and masked.count() == len(rows) and masked.filter("text IS NULL").count() == 2
    assert masked.filter("text LIKE '%[EMAIL]%'").select("doc_id").collect() == [(4,)]
    pieces = corpus_pipeline.pack(spark, docs, data)
    assert pieces.filter("start = 0").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
