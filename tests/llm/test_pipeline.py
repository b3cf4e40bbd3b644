"""Stages of the corpus pipeline against what their operators say, one after the other."""

from test_ngramjoin import brute

import corpus_pipeline
from tidemark.llm import quality, toxicity
from tidemark.llm.common import table, written


def test_stages(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality classifier", "n-gram Jaccard join", "packing"]

    toxic = toxicity.fit_toxicity(docs, labels)
    kept = written(stages["toxicity"](spark, docs, sf), "t1")
    assert kept.schema == docs.schema
    score = dict(zip(rows, toxic.score([t or "" for t in rows.values()]), strict=True))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in rows if score[i] < toxicity.CUT}

    net = quality.fit_quality(docs, labels)
    good = written(stages["quality classifier"](spark, kept, sf), "t2")
    assert good.schema == docs.schema
    own = {r["doc_id"]: r["text"] for r in kept.collect()}
    p = dict(zip(own, net.score([(t or "").encode() for t in own.values()]), strict=True))
    assert {r["doc_id"] for r in good.collect()} == {i for i in own if p[i] >= quality.CUT}

    single = written(stages["n-gram Jaccard join"](spark, good, sf), "t3")
    assert single.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in good.collect()}
    assert {r["doc_id"] for r in single.collect()} == {i for i, (c, _) in brute(left).items() if i == c}

    packed = stages["packing"](spark, single, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in single.collect()}
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_whole_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_rows_through_all_stages(spark, sf):
    """Null and repeated ids, null and empty texts, ties and clashing columns."""
    docs = table(spark, sf, "documents")
    clean = [r["text"] for r in docs.where("length(text) between 300 and 900 and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    odd = [(None, clean[0]), (None, clean[1]), (1, clean[2]), (1, clean[3]), (7, clean[2]), (8, clean[4]), (8, clean[4]), (9, None), (10, ""), (None, None)]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long, uid long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        assert {r["uid"] for r in out.collect()} <= set(range(len(odd)))
    kept = {r["uid"] for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, extra, sf).collect()}
    assert {0, 1, 2, 3, 7, 8, 9} <= kept and 4 not in kept and len(kept & {5, 6}) == 1
    assert dict(corpus_pipeline.STAGES)["packing"](spark, extra, sf).select("doc_id", "start").count() >= len(odd)
