"""The pipeline stage by stage against each operator's own decisions."""

import pytest

import corpus_pipeline
from lumenreel.llm import common, decontaminate, pieces, pseudonyms, simhash, toxicity

SF01 = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.read(spark, SF01, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "sentencepiece"]
    scored = toxicity.score(docs, toxicity.fit(docs, common.read(spark, SF01, "labels")))
    one = common.materialize(stage["toxicity"](spark, docs, SF01))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(one) == ids(scored.where("score < 0.7"))
    two = common.materialize(stage["simhash near-dedup"](spark, one, SF01))
    assert ids(two) == sorted({r["component_id"] for r in simhash.near_duplicates(one).collect()})
    three = common.materialize(stage["benchmark decontamination"](spark, two, SF01))
    gone = {r["doc_id"] for r in decontaminate.contaminated(two, common.read(spark, SF01, "benchmark")).collect()}
    assert gone and ids(three) == [i for i in ids(two) if i not in gone]
    four = common.materialize(stage["pii"](spark, three, SF01))
    key = pseudonyms._key(pseudonyms.DEMONSTRATION_KEY)
    want = {r["doc_id"]: pseudonyms.pseudonymise_text(r["text"], key)[0] for r in three.collect()}
    assert {r["doc_id"]: r["text"] for r in four.collect()} == want
    for df in (one, two, three, four):
        assert df.dtypes == docs.dtypes
    five = stage["sentencepiece"](spark, four, SF01)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(five).collect()}
    assert back == want and five.where("not exact").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, "a", "b"), (2, "", "en", None, 0, "a", None), (2, "", "en", None, 0, "a", None), (None, "some words here", None, "s", 5, None, "b")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_key string, score string")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, "/root/testdata/sf0.001"))
        assert (docs.count() > 0) == bool(rows), name
