import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pyspark.sql import functions as F

from logstrata.llm import pieces, token_counts

from .brute import frame

ODD = ["", "   ", " a", "a ", "aaaa aaaaaaaa aaaaaaaaaaaaaaaaaaaaaaaa", "  hi  there\n\tx  ", "▁a ▁ b", "ﬁ Ǻ 　x", "日本語テスト\x00 😀😀 zażółć", "=====----====####" * 7,
       "<|startoftext|>hi<|endoftext|> x", "<|startoftext|> <|end oftext|>", "é ́a it's 's don't", "a b c\x85d\x1ce", "İSTANBUL ΑΣ ΑΣ.", "</s> <s> <unk> <0x41>"]


def texts():
    rnd = random.Random(3)
    letters = "abcdehinorst  \n.,éß日😀▁01=-ab'"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)] + ["word and more " * 9000, "x" * 3000]


def test_counts_equal_the_library(spark):
    own = texts()
    want = [len(x) for x in token_counts.load("word_bpe_49k.json").encode_batch(own, add_special_tokens=False)]
    found = token_counts.token_counts(frame(spark, [*enumerate(own), (None, "hello"), (0, None)]), remember=500).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=repr) == sorted(
        [(k, len(t.encode()), n, n > 2048) for k, (t, n) in enumerate(zip(own, want))] + [(None, 5, 1, False), (0, 0, 0, False)], key=repr
    )
    assert token_counts.token_counts(frame(spark, []).where("false")).collect() == []


def test_pieces_equal_the_library(spark):
    own, library = texts(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = frame(spark, [*enumerate(own), (None, None)])
    coded = pieces.decode(pieces.encode(docs, remember=300))
    assert set(coded.columns) == set(docs.columns)
    found = {r.doc_id: (r.piece_ids, r.decoded) for r in coded.select("doc_id", "piece_ids", "decoded").collect()}
    for k, text in enumerate(own):
        ids = library.encode(text)
        assert found[k] == (ids, library.decode(ids)), text[:50]
    assert found[None] == ([], "")
    assert {r.doc_id: r.decoded for r in pieces.encode(docs, and_decode=True).collect()} == {k: d for k, (_, d) in found.items()}
    assert pieces.encode(docs.where("false")).collect() == []


def test_decoding_of_any_ids():
    rnd, library = random.Random(5), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [[rnd.choice([rnd.randrange(3, 32000), rnd.randrange(3, 259)]) for _ in range(rnd.randrange(12))] for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"piece_ids": pa.array(ids, pa.list_(pa.int32()))})
    found = [t for part in pieces._decode(pieces.MODEL, 50)([batch]) for t in part.column(1).to_pylist()]
    assert found == [library.decode(x) for x in ids]


def test_weights_leave_one_path():
    machine = pieces.load(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 9)))
        ids = machine._known(text)
        states = {0: {-1: 1}}  # paths of finite weight, by end and last piece
        for end in range(1, len(text) + 1):
            states[end] = {}
            for start in range(end):
                piece = machine.ids.get(text[start:end])
                for before, count in states[start].items():
                    if piece is not None and machine.weight(before, piece) == 0.0:
                        states[end][piece] = states[end].get(piece, 0) + count
            assert sum(states[end].values()) == 1
        assert list(states[len(text)]) == ids[-1:]
    assert [machine.texts[k] for k in machine.shortest_path("▁hello")] == library.encode("hello", out_type=str)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_keep_clashing_columns(spark):
    rows = pieces.encode(frame(spark, ["one", "two"]).withColumn("_text", F.upper("text"))).collect()
    assert sorted((r.text, r["_text"]) for r in rows) == [("one", "ONE"), ("two", "TWO")]
