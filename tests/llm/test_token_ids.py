import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logstrata.llm import token_ids as t
from logstrata.llm.arrays import flat
from logstrata.llm.token_counts import tokenizer_path

from .brute import frame

LIBRARY = Tokenizer.from_file(tokenizer_path(t.TOKENIZER))
PARTS = ["a", "the", "don't", "Ünïcode", "日本", "語", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", " ", "\x85", "\x1c", "\x0b", "12", "3.5", "<|endoftext|>", "<|end", "of", "!", "...", "'s", "'ll", "it", "(", "×", "÷", "ŝ", "…", "-", "|", ">", "x,y", "'", "😀", "́", "é"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def texts(n=400):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_encoder_is_the_library():
    docs = texts(3000)
    for remember in (50, 10**6):
        encode = t.Encoder(t.TOKENIZER, remember)
        for at in range(0, len(docs), 150):
            part = docs[at : at + 150]
            data, offsets = flat(pa.array([x.encode() for x in part], pa.large_binary()))
            found, by_text = encode(data, offsets, 2)
            assert [found[a:b].tolist() for a, b in zip(by_text, by_text[1:])] == [ids(x) for x in part]
    data, offsets = flat(pa.array([], pa.large_binary()))
    assert t.Encoder(t.TOKENIZER, 9)(data, offsets, None)[0].tolist() == []


def documents():
    docs = [(3 * k % 401, x) for k, x in enumerate(texts())]
    return docs + [(500, None), (501, ""), (None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (502, "long word " * 60_000), (503, "x" * 70_000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ids')}/set"
    t.write_ids(frame(spark, documents()), path, file_bytes=3000)
    return path


def test_round_trip(spark, folder):
    docs = documents()
    rows = sorted(t.read_ids(spark, folder, chunk=1000).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=repr) == sorted(((k, ids(x)) for k, x in docs), key=repr)
    assert [r.doc_id for r in rows] == sorted((k for k, _ in docs), key=lambda k: (k is not None, k or 0))
    assert all(4 * r.n_tokens == len(r.ids) for r in rows)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    files = t.manifest(spark, folder).collect()
    assert len(files) > 4 and sum(f.n_docs for f in files) == len(docs)


def test_single_documents(folder):
    docs = documents()
    for k in (0, 7, 100, 400, 500, 501, 502, 503):
        assert sorted(x.tolist() for x in t.read_document(folder, k)) == sorted(ids(x) for d, x in docs if d == k)
    assert t.read_document(folder, 999_999) == []


def test_dictionary_pays_and_is_checked(spark, folder, tmp_path):
    short = frame(spark, [(k, f"Report {k % 13} of the committee on weights and measures, part {k}.") for k in range(500)])
    t.write_ids(short, f"file://{tmp_path}/with")
    t.write_ids(short, f"file://{tmp_path}/without", sample=1)
    size = [sum(f.n_bytes for f in t.manifest(spark, f"file://{tmp_path}/{x}").collect()) for x in ("with", "without")]
    assert (tmp_path / "with/dictionary").stat().st_size > 0 and size[0] < 0.8 * size[1]
    (tmp_path / "with/dictionary").write_bytes(b"another")
    with pytest.raises(ValueError):
        t.read_document(f"file://{tmp_path}/with", 3)


def test_empty_table(spark, tmp_path):
    t.write_ids(frame(spark, []).where("false"), f"file://{tmp_path}/none")
    assert t.read_ids(spark, f"file://{tmp_path}/none").collect() == []


def test_query(spark):
    from logstrata.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op12_token_id_files"](spark, "/root/testdata/sf0.001").collect()}, 0
    for k, x in sorted((r.doc_id, r.text) for r in docs):
        own = np.array(ids(x), "<u4")
        assert found.pop(k) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert not found
