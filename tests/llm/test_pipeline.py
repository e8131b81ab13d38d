import os

import corpus_pipeline
import __spark_entry__
from terranet.llm import decontaminate, labelled, line_crf, mixture
from tests.llm.fixtures import jaccard, shingles

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    kept = []
    for name in names[:4]:
        docs = stage[name](spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.cache())
        docs = kept[-1]
    everything = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = line_crf.train(labelled.sample(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality", 5, 0, line_crf.SAMPLE))
    scores = {r["doc_id"]: r["score"] for r in line_crf.scored(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    good = {r["doc_id"] for r in kept[0].collect()}
    assert good == {d for d, s in scores.items() if s >= line_crf.CUT}
    # one of each group of near copies: all pairs
    sets = {d: shingles(everything[d]) for d in good}
    group = {d: d for d in good}
    for d in sorted(good):
        for e in sorted(good):
            if e < d and (everything[d] == everything[e] or sets[d] and jaccard(sets[d], sets[e]) >= 0.8):
                a, b = group[d], group[e]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    alone = {r["doc_id"] for r in kept[1].collect()}
    assert alone == {d for d in good if group[d] == d} and len(alone) < len(good)
    leaks = {r["doc_id"] for r in decontaminate.contaminated(kept[1], benchmark).collect()}
    clean = {r["doc_id"] for r in kept[2].collect()}
    assert leaks and clean == alone - leaks
    taken = {r["doc_id"]: r for r in mixture.mixed_documents(kept[2]).collect()}
    mixed = kept[3].groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {
        d: (r["first_part"] > 0) + (r["second_part"] > 0) for d, r in taken.items() if r["taken"]}
    out = stage[names[4]](spark, docs, SF).collect()
    assert len(out) == kept[3].count()


def test_registered_queries_and_whole_run(spark):
    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert os.path.exists(f"{SF}/documents.parquet")
