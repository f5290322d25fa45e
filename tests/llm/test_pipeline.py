"""The pipeline on a small table with nulls, empty and long texts, ties, repeated rows, shared ids and a clashing column."""

import random
from collections import Counter

import corpus_pipeline
from test_quality import clean, junk

from quarry.llm import ngram_join, quality_classifier, quality_rules


def documents(spark):
    rnd = random.Random(31)
    rows = [(i, clean(rnd.randint(60, 140), rnd), "en", "s0") for i in range(120)] + [(500 + i, junk(80, rnd), "en", "s0") for i in range(120)]
    twin = rows[3][1]
    rows += [(1000, twin, "en", "s0"), (1001, twin + " end", "en", "s0"), (4, rows[4][1], "en", "s0"), (5, clean(90, rnd), "en", "s0"), (None, clean(90, rnd), "en", "s0"),
             (1002, None, "en", "s0"), (1003, "", None, None), (1004, clean(6000, rnd), "en", "s0"), (1005, clean(80, rnd), None, None)]
    docs = spark.createDataFrame([(*r, 7, 0.5) for r in rows], "doc_id long, text string, lang string, source string, kept int, score double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(500 + i, 0, 0) for i in range(0, 120, 2)] + [(None, 1, None), (1002, None, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_stages_in_order(spark, tmp_path):
    docs, labels, rows = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # each stage on what the one before kept, by the operators' own verdicts
    scored = quality_classifier.classify(docs, quality_classifier.train(docs, labels))
    good = Counter(r.doc_id for r in scored.collect() if r.predicted)
    assert sum(good.values()) >= 120
    kept = quality_classifier.keep_good(docs, quality_classifier.train(docs, labels))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == good
    ruled = quality_rules.keep_good(kept)
    verdicts = quality_rules.apply_rules(kept).collect()
    assert ruled.columns == docs.columns and Counter(r.doc_id for r in ruled.collect()) == Counter(r.doc_id for r in verdicts if r.kept)
    single = ngram_join.keep_one_each(ruled)
    left = Counter(r.doc_id for r in single.collect())
    assert single.columns == docs.columns and 1000 not in left and 1001 not in left and left[4] == 1 and left[5] == 2 and left[None] == 1 and left[3] == 1
    assert Counter(p.doc_id for p in pieces if p.start == 0) == left
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048


def test_no_documents(spark, tmp_path):
    docs, labels, _ = documents(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
