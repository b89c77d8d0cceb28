"""Token ids of documents in files of single compressed documents, with a shared zstandard dictionary.

Texts are cut before blanks, where the byte-level tokenizer cuts too, so the ids of the pieces follow one another; each distinct
piece of a slice is encoded once, and pieces met before in the task are remembered. A document's ids, ended by the end id, are
serialised as little-endian unsigned 32-bit integers and compressed as one zstandard frame with a dictionary that is trained once on
a sample of such arrays. So a short document is small, and can be read alone.

A file has, in this order: MAGIC; the dictionary's SHA-256 (32 bytes); the frames; the offset index, an Arrow IPC stream of doc_id,
offset (of the frame, from the start of the file), n_tokens; the index's offset and length (two little-endian unsigned 64-bit
integers); MAGIC. Documents are ordered by id over all files; the manifest, a Parquet table, has a row for each file. A task that is
run twice leaves files that no manifest names, and nobody reads those.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import hash_spans, ragged, sizes, slices
from .token_counts import BATCH_BYTES, load

TOKENIZER, END_ID, MAGIC = "byte_bpe_50k.json", 2, b"TOKENIDS"
FILE_BYTES, REMEMBER, LEVEL = 32 << 20, 1_000_000, 3
#: The dictionary is trained on about SAMPLE documents, on at most CLIP bytes of ids of each.
SAMPLE, CLIP, DICTIONARY_BYTES = 1000, 4096, 64 << 10
TAIL = struct.Struct("<QQ8s")

_LETTER = np.zeros(256, bool)  # bytes that begin a character which is no blank of any script
_LETTER[33:127] = _LETTER[0xC3:0xF5] = True
_LETTER[[0xE1, 0xE2, 0xE3]] = False
_ASCII = np.zeros(256, bool)
_ASCII[33:127] = True
_LATIN = np.zeros(256, bool)  # ASCII letters
_LATIN[65:91] = _LATIN[97:123] = True
_MARK = _ASCII & ~_LATIN  # ASCII marks that are no part of a special string, and begin no contraction
_MARK[48:58] = False
_MARK[[ord(c) for c in "<|>'"]] = False
#: Bytes of characters that are no blanks. Pieces of these, after a blank at most, keep their ids if a line feed joins them.
_PLAIN = _LETTER.copy()
_PLAIN[0x80:0xC0] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, texts included: before a blank that a character follows, around a lone line feed between characters, and
    between a Latin letter and a mark."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        last = np.zeros(len(data), bool)  # a cut needs neighbours in its own text
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inner = ~last[1:-1] & ~first[1:-2]
        after = _LETTER[data[2:]]
        begins[1:-2] = inner & after & (data[1:-1] == 32)
        feed = inner & after & (data[1:-1] == 10) & _ASCII[data[:-2]]
        begins[1:-2] |= feed
        begins[2:-1] |= feed
        a, b = data[:-1], data[1:]
        letter = _LATIN[a]  # or one of U+00C0 to U+017F, all letters but two
        letter[1:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xC5) & (a[1:] >= 0x80) & (a[1:] < 0xC0) & ~((data[:-2] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7)))
        begins[1:-1] |= ~last[:-1] & (letter & _MARK[b] | _MARK[a] & _LATIN[b])
    begins[offsets] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


@lru_cache(maxsize=1)
def encoder(tokenizer: str, remember: int = REMEMBER) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Encoder(tokenizer, remember)


class Encoder:
    """Ids of the texts of a slice; remembers up to `remember` pieces."""

    def __init__(self, tokenizer: str, remember: int):
        self.tokenizer, self.remember = load(tokenizer), remember
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.end = np.zeros(1 << 14, np.uint32), 0

    def learn(self, hashes: list[int], pieces: list[bytes], plain: np.ndarray) -> None:
        """plain: which pieces may be joined by line feeds, which saves most of the library's time for each text."""
        for joined in (True, False):
            own = np.flatnonzero(plain == joined).tolist()
            ends, at = np.cumsum([len(pieces[k]) + 8 for k in own]), 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
                batch = [pieces[k] for k in own[at:to]]
                flat, counts = self.joined(batch) if joined else self.single(batch)
                self.keep([hashes[k] for k in own[at:to]], flat, counts)
                at = to

    def single(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [c.ids for c in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])

    def joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        (coded,) = self.tokenizer.encode_batch_fast([b"\n".join(pieces).decode()], add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        feed = ids == self.feed
        if np.count_nonzero(feed) != len(pieces) - 1:
            return self.single(pieces)
        return ids[~feed], np.diff(np.flatnonzero(feed) - np.arange(len(pieces) - 1), prepend=0, append=len(ids) - len(pieces) + 1)

    def keep(self, hashes: list[int], flat: np.ndarray, counts: np.ndarray) -> None:
        n, more = len(self.known), len(counts)
        while n + more > len(self.starts):
            self.starts, self.counts = np.append(self.starts, self.starts * 0), np.append(self.counts, self.counts * 0)
        while self.end + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, self.ids * 0)
        self.starts[n : n + more], self.counts[n : n + more] = self.end + np.cumsum(counts) - counts, counts
        self.ids[self.end : self.end + len(flat)] = flat
        self.end += len(flat)
        self.known.update(zip(hashes, range(n, n + more)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, each text ended by end_id if given; and the len + 1 offsets into them."""
        begins = cuts(data, offsets)
        ends = np.append(begins[1:], len(data)) if len(begins) else begins
        keys, first, inverse = np.unique(hash_spans(data, begins, ends), return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) + len(keys) > self.remember:
            self.forget()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        raw, odd = data.tobytes(), np.append(0, np.cumsum(~_PLAIN[data]))
        a, b = begins[first[new]], ends[first[new]]
        blank = data[a] == 32 if len(a) else a > 0
        plain = (odd[b] - odd[a] == blank) & (b - a > blank)
        self.learn([keys[k] for k in new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist())], plain)
        place = np.array([self.known[key] for key in keys], np.int64)[inverse.ravel()] if keys else np.zeros(0, np.int64)
        counts = self.counts[place]
        ids = self.ids[ragged(self.starts[place], counts)]
        by_text = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, offsets)]
        if end_id is None:
            return ids, by_text
        return np.insert(ids, by_text[1:], np.uint32(end_id)), by_text + np.arange(len(by_text))


def serialised(ids: np.ndarray, by_text: np.ndarray) -> Iterator[bytes]:
    raw = ids.astype("<u4").tobytes()
    for a, b in zip((4 * by_text[:-1]).tolist(), (4 * by_text[1:]).tolist()):
        yield raw[a:b]


def train(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE, clip: int = CLIP, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the ids of about `sample` rows (text), `clip` bytes each; empty if there are too few to train on."""

    def heads(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for _, data, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([x[:clip] for x in serialised(*encode(data, offsets, end_id))], pa.binary())], ["ids"])

    rows = docs.count()
    chosen = docs.select("text") if rows <= sample else docs.select("text").sample(sample / rows, seed=7)
    samples = [bytes(r.ids) for r in chosen.mapInArrow(heads, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coder(kind, dictionary: bytes, **more):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **more) if dictionary else kind(**more)


class _File:
    """A file that is being written, and its row of the manifest."""

    def __init__(self, folder: str, part: int, number: int, digest: bytes):
        self.name, self.part, self.number = f"part-{part:06d}-{number:06d}-{uuid4().hex}.ids", part, number
        fs, path = pafs.FileSystem.from_uri(folder)
        self.out = fs.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC + digest)
        self.at, self.ids, self.offsets, self.counts = len(MAGIC) + len(digest), [], [], []

    def add(self, doc_id, frame: bytes, n_tokens: int) -> None:
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(n_tokens)
        self.out.write(frame)
        self.at += len(frame)

    def close(self, kind: pa.DataType) -> pa.RecordBatch:
        index = pa.table({"doc_id": pa.array(self.ids, kind), "offset": pa.array(self.offsets, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        tail = sink.getvalue().to_pybytes()
        self.out.write(tail + TAIL.pack(self.at, len(tail), MAGIC))
        self.out.close()
        row = {"file": [self.name], "part": [self.part], "number": [self.number], "n_docs": [len(self.ids)], "n_tokens": [sum(self.counts)], "n_bytes": [self.at + len(tail) + TAIL.size]}
        first = next((x for x in self.ids if x is not None), None)  # nulls come first
        row = pa.table(row | {"first_id": pa.array([first], kind), "last_id": pa.array(self.ids[-1:], kind)})
        return row.to_batches()[0]


def write_ids(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID,
    file_bytes: int = FILE_BYTES, sample: int = SAMPLE, level: int = LEVEL,
) -> None:
    """Write the token ids of every row's whole text below `folder`, which every executor must reach (a URI or path for pyarrow.fs):
    `dictionary`, `manifest` (Parquet) and the files, of about `file_bytes` each.

    Rows are ordered by id (null first), rows of one id by a hash of their text; equal rows are kept. A null text counts as empty and
    has the end id only. Rows are range-partitioned, so no task holds more than its share; rows that agree in id and text stay
    together. Memory is bounded by a slice of texts, the longest text, and the index of one file. Other columns are not looked at.
    The tokenizer must be byte-level without a normaliser or prefix blank, as the default is; pieces are told apart by 64-bit hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train(rows, tokenizer, end_id, sample)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/files", recursive=True)
    with fs.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def write(batches):
        compress, encode, file, files = _coder(zstandard.ZstdCompressor, dictionary, level=level).compress, encoder(tokenizer), None, 0
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, by_text = encode(data, offsets, end_id)
                for key, raw in zip(part.column(0).to_pylist(), serialised(ids, by_text)):
                    if file is None:
                        file, files = _File(f"{folder}/files", TaskContext.get().partitionId(), files, digest), files + 1
                    file.add(key, compress(raw), len(raw) // 4)
                    if file.at >= file_bytes:
                        yield file.close(part.schema.field(0).type)
                        file = None
        if file is not None:
            yield file.close(part.schema.field(0).type)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = f"file string, part long, number long, n_docs long, n_tokens long, n_bytes long, first_id {kind}, last_id {kind}"
    rows.mapInArrow(write, columns).write.parquet(f"{folder}/manifest")


def read_index(source, size: int) -> tuple[pa.Table, bytes]:
    """The offset index of an opened file of `size` bytes, and the SHA-256 of its dictionary. The index has one more column, end."""
    source.seek(size - TAIL.size)
    at, length, magic = TAIL.unpack(source.read(TAIL.size))
    source.seek(0)
    head = source.read(len(MAGIC) + 32)
    if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    source.seek(at)
    index = pa.ipc.open_stream(source.read(length)).read_all().combine_chunks()
    ends = np.append(index["offset"].to_numpy()[1:], at)
    return index.append_column("end", pa.array(ends, pa.int64())), head[len(MAGIC) :]


def _decompressor(fs, path: str, digest: bytes):
    with fs.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the dictionary is not the one that the file was written with")
    return _coder(zstandard.ZstdDecompressor, dictionary)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file in order, with `start`, the number of ids in the files before it. The window has one row per file."""
    rows = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str, chunk: int = 4 << 20) -> DataFrame:
    """All documents of `folder`: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32, binary).
    Files are read in chunks of about `chunk` bytes by the tasks; the order of the rows is that of `start`, not of the frame."""
    files = manifest(spark, folder)
    kind = files.schema["first_id"].dataType.simpleString()

    def read(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with fs.open_input_file(f"{path}/files/{name}") as source:
                    index, digest = read_index(source, size)
                    expand = _decompressor(fs, path, digest).decompress
                    counts, offsets, ends = (index[c].to_numpy() for c in ("n_tokens", "offset", "end"))
                    starts, at = start + np.cumsum(counts) - counts, 0
                    while at < len(counts):  # documents of about `chunk` bytes of ids
                        to = max(at + 1, int(np.searchsorted(np.cumsum(4 * counts[at:]), chunk)) + at)
                        source.seek(int(offsets[at]))
                        raw = source.read(int(ends[to - 1] - offsets[at]))
                        ids = [expand(raw[a:b]) for a, b in zip((offsets[at:to] - offsets[at]).tolist(), (ends[at:to] - offsets[at]).tolist())]
                        keys = index["doc_id"].slice(at, to - at).combine_chunks()
                        yield pa.RecordBatch.from_arrays([keys, pa.array(starts[at:to]), pa.array(counts[at:to]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        at = to

    spread = files.select("file", "n_bytes", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_document(folder: str, doc_id) -> list[np.ndarray]:
    """The ids of every row of one document (its id is not null): reads the manifest's matching rows, the index of their files and the frames alone."""
    fs, path = pafs.FileSystem.from_uri(folder)
    rows, found = pq.read_table(f"{path}/manifest", filesystem=fs, columns=["file", "n_bytes", "first_id", "last_id"], filters=[("first_id", "<=", doc_id), ("last_id", ">=", doc_id)]), []
    for row in sorted(rows.to_pylist(), key=lambda r: r["file"]):
        with fs.open_input_file(f"{path}/files/{row['file']}") as source:
            index, digest = read_index(source, row["n_bytes"])
            expand = _decompressor(fs, path, digest).decompress
            for k in np.flatnonzero(index["doc_id"].to_numpy(zero_copy_only=False) == doc_id).tolist():
                source.seek(index["offset"][k].as_py())
                found.append(np.frombuffer(expand(source.read(index["end"][k].as_py() - index["offset"][k].as_py())), "<u4"))
    return found
