import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from logstrata.llm import decontaminate, quality

from . import brute

FOLDER = "/root/testdata/sf0.001"


def overlapping(text, items):
    doc = re.findall(r"[^\W_]+", text.lower())
    for item in items:
        for shift in range(-len(item), len(doc)):
            a, b = max(0, -shift), min(len(item), len(doc) - shift)
            if b > a:
                import numpy as np

                same = np.array([doc[i + shift] == item[i] for i in range(a, b)])
                if same.sum() >= 13 and decontaminate.best_overlap(same, decontaminate.SHARE)[2] >= min(13, len(item)):
                    return True
    return False


def test_against_plain_python(spark):
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = quality.with_quality(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("score >= 0.5").select("doc_id", "text").collect()
    latest = {r.text: r.doc_id for r in sorted(docs)}
    docs = sorted((k, t) for t, k in latest.items())
    near = brute.near(docs)
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(k, t) for k, t in docs if near[k][1] == k and not overlapping(t, items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(found) == [k for k, _ in docs]
    assert all(found[k].text == t and found[k].piece_ids == library.encode(t) and found[k].round_trip for k, t in docs)


def test_stages(spark):
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == names
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), FOLDER).count() == 0
