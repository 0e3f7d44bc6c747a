"""The pipeline against its stages' own rules, on the smallest tables and on odd rows."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from quillspark.llm import langid, minhash, packing, pii, toxicity
from quillspark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents").cache()
    known = {r["doc_id"] for r in langid.predict(docs, langid.learn(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST}
    learned = toxicity.learn(docs.where(docs.doc_id.isin(list(known))), table(spark, SF, "labels"))
    clean = known & {r["doc_id"] for r in toxicity.score(docs, learned).collect() if not r["predicted"]}
    left = docs.where(docs.doc_id.isin(list(clean)))
    one = {r["doc_id"] for r in minhash.near_duplicates(left).collect() if r["kept"]}
    texts = pii.redact(left.where(left.doc_id.isin(list(one))))
    words = packing.word_tokenizer(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(words.encode_batch([r["text"]])[0]) // 4 + 1 for r in texts.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_stay(spark, stage):
    docs = table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "plain words here", "en", "s", 3)], docs.schema)
    every = docs.union(odd)
    out = stage[1](spark, every, SF)
    assert out.dtypes == every.dtypes
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in every.collect()}
    assert stage[1](spark, every.limit(0), SF).count() == 0
