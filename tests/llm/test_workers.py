"""How often a text goes through Python: a task needs a worker, with its memory, for each evaluation in its plan."""

import public_tokenizers

import corpus_pipeline
from quillspan.llm import byte_bpe, language_id
from tests.conftest import DATA


def evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_stages_evaluate_each_text_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    assert evaluations(corpus_pipeline.language(spark, docs, DATA)) == 1
    assert evaluations(corpus_pipeline.tokens(spark, docs, DATA)) == 1
    assert evaluations(byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)) == 1
    profiles = language_id.train(docs)
    assert evaluations(language_id.predict(docs, profiles).where("lang_pred = lang AND score > 0")) == 1
