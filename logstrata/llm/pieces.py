"""SentencePiece encoding and decoding as weighted transduction.

Three machines are compiled from the model: a normaliser (blanks become the mark U+2581, one is put first), the pieces (a path from a
string to an id), and byte fallback (a character that no piece has becomes its UTF-8 bytes). Composed with an input they give a
lattice whose tropical-semiring shortest path is the encoding.

For a unigram model an arc's weight is minus its piece's score. A BPE model's encoding is the result of merges in order of score,
which no sum of scores gives. Its weights come from a fourth machine, over pairs of neighbouring pieces: an arc from piece p to piece
q weighs nothing if the model's merges, applied to the text of p and q alone, end in p and q, and infinity otherwise. One path of
finite weight is left for every prefix of an input, and it is what the merges give.

No piece has the mark after another character, so inputs are cut before every run of marks, and an input is encoded once in a task
for all its occurrences (up to `remember` of them).
"""

from __future__ import annotations

import codecs
from array import array
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, hash_spans, list_array, map_slices, ragged, unused
from .token_counts import tokenizer_path

MODEL, REMEMBER = "piece_bpe_32k.model", 150_000
MARK = "▁"
INF = float("inf")
FIRST = 0x5BF03635D1F0A1B7  # tells an input at the start of a text, where a mark is put before it


def fields(message: bytes):
    """The (number, value) pairs of a protocol buffer message; values are integers or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        self.texts, self.scores, self.kinds = [], [], []
        for entry in (dict(fields(v)) for n, v in model if n == 1):
            self.texts.append(entry.get(1, b"").decode())
            self.scores.append(float(np.frombuffer(entry.get(2, bytes(4)), "<f4")[0]))
            self.kinds.append(entry.get(3, 1))
        trainer, normaliser = (dict(fields(dict(model).get(n, b""))) for n in (2, 3))
        # model_type, byte_fallback; charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
        self.bpe = {1: False, 2: True}.get(trainer.get(3, 1))
        if self.bpe is None or not trainer.get(35, 0) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only unigram and BPE models with byte fallback and the identity normaliser are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.ids = {t: k for k, (t, kind) in enumerate(zip(self.texts, self.kinds)) if kind == 1}
        self.bytes = {int(t[3:5], 16): k for k, (t, kind) in enumerate(zip(self.texts, self.kinds)) if kind == 6}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces across words are not supported")
        self.sizes = [len(t) for t in self.texts]
        self.chars = frozenset("".join(self.ids))
        if not self.chars <= self.ids.keys():
            raise ValueError("a character of a piece must be a piece")
        self.automaton = ahocorasick.Automaton()
        for text, piece in self.ids.items():
            self.automaton.add_word(text, piece)
        self.automaton.make_automaton()
        self.pairs: dict[int, float] = {}
        self.unknown = len(self.texts)
        plain = [bytes([int(t[3:5], 16)]) if kind == 6 else t.replace(MARK, " ").encode() if kind == 1 else b" \xe2\x81\x87 " if kind == 2 else b"" for t, kind in zip(self.texts, self.kinds)]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_size = np.array([len(p) for p in plain])
        self.plain_at = np.cumsum(self.plain_size) - self.plain_size

    def merged(self, text: str) -> list[str]:
        """The symbols that merging leaves of a short text: the neighbours with the best joint piece first, from the left."""
        symbols = list(text)
        while True:
            joint = [(-self.scores[k], i) for i in range(len(symbols) - 1) if (k := self.ids.get(symbols[i] + symbols[i + 1])) is not None]
            if not joint:
                return symbols
            i = min(joint)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def weight(self, before: int, piece: int) -> float:
        """Weight of the arc to `piece` after `before` (-1: at the start) in a BPE model."""
        own = self.texts[piece]
        expected = [own] if before < 0 else [self.texts[before], own]
        found = 0.0 if self.merged("".join(expected)) == expected else INF
        self.pairs[(before + 1) * self.unknown + piece] = found
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the least-weight path over the normalised text."""
        if self.chars.issuperset(text):
            return self._known(text)
        out = []  # every path passes through a character without a piece, so the parts around it are independent
        for known, part in groupby(text, self.chars.__contains__):
            part = "".join(part)
            out += self._known(part) if known else [self.bytes[b] for b in part.encode()]
        return out

    def _known(self, text: str) -> list[int]:
        pieces = self._only_path(text) if self.bpe else self._least_path(text)
        out, end, sizes = [], len(text), self.sizes
        while end:
            out.append(pieces[end])
            end -= sizes[pieces[end]]
        return out[::-1]

    def _only_path(self, text: str) -> list[int]:
        """Last piece of the path to each position. Finite weights are 0, so the first finite arc is the shortest path."""
        last, known, unknown, sizes = [-1] * (len(text) + 1), self.pairs.get, self.unknown, self.sizes
        for end, piece in self.automaton.iter(text):  # all arcs, by their ends
            end += 1
            if last[end] < 0:
                before = last[end - sizes[piece]]
                step = known((before + 1) * unknown + piece)
                if step == 0.0 or step is None and self.weight(before, piece) == 0.0:
                    last[end] = piece
        return last

    def _least_path(self, text: str) -> list[int]:
        weights, pieces = [0.0] + [INF] * len(text), [-1] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):
            total = weights[end + 1 - self.sizes[piece]] - self.scores[piece]
            if total < weights[end + 1]:
                weights[end + 1], pieces[end + 1] = total, piece
        return pieces

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of several id sequences; bytes that are no UTF-8 become U+FFFD, one each."""
        sizes = self.plain_size[ids]
        raw = self.plain[ragged(self.plain_at[ids], sizes)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        texts = [raw[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts[:-1], cuts[1:])]
        heads = [self.texts[ids[k]] if k < to else "" for k, to in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [t[1:] if self.prefix and h.startswith(MARK) else t for t, h in zip(texts, heads)]


codecs.register_error("each_byte", lambda error: ("�", error.start + 1))


@lru_cache(maxsize=2)
def load(name: str) -> Transducer:
    return Transducer(tokenizer_path(name))


def without_marks(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with the mark turned into a blank; the model cannot tell them apart."""
    if MARK.encode() not in data.tobytes():
        return data, offsets
    raw = [data[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def encode_slice(machine: Transducer, known: dict[int, bytes], remember: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their offsets by text."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    blank = data == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    cut[heads] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    keys = hash_spans(data, starts, ends)
    at_head = np.searchsorted(starts, heads)
    if machine.prefix:
        keys[at_head] ^= U(FIRST)
    lead = np.zeros(len(starts), bool)
    lead[at_head] = machine.prefix
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    found = [known.get(k) for k in unique.tolist()]
    new = [k for k, ids in enumerate(found) if ids is None]
    if len(known) + len(new) > remember:
        known.clear()
    if len(machine.pairs) > 2 * remember:
        machine.pairs.clear()
    raw = data.tobytes()
    for k in new:
        a = first[k]
        text = (MARK if lead[a] else "") + raw[starts[a] : ends[a]].decode().replace(" ", MARK)
        known[int(unique[k])] = found[k] = array("i", machine.shortest_path(text)).tobytes()
    size = np.array([len(x) >> 2 for x in found])
    ids = np.frombuffer(b"".join(found), np.int32)
    ids = ids[ragged((np.cumsum(size) - size)[inverse], size[inverse])]
    return ids, np.concatenate([[0], np.cumsum(size[inverse])])[np.searchsorted(starts, offsets)]


def _encode(name: str, remember: int, and_decode: bool, own: str):
    known: dict[int, bytes] = {}

    def fn(batch, data, offsets):
        machine = load(name)
        ids, cuts = encode_slice(machine, known, remember, *without_marks(batch, data, offsets))
        columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names) if f != own}
        columns["piece_ids"] = list_array(cuts, pa.array(ids))
        if and_decode:
            columns["decoded"] = pa.array(machine.decode(ids, cuts), pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_slices(fn, own)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, remember: int = REMEMBER, and_decode: bool = False) -> DataFrame:
    """docs with a column piece_ids array<int>, as the library's encode gives them, and if asked for, a column decoded with the text
    that they decode to, from the same pass; columns of these names are replaced.

    A null or empty text has no pieces. Rows keep their other columns; order is not kept. Inputs are told apart by 64-bit hash.
    """
    source = docs.drop("piece_ids", *["decoded"] * and_decode)
    schema = f"{_ddl(source)}, piece_ids array<int>{', decoded string' if and_decode else ''}"
    own = unused(source.columns, "_text")
    return source.withColumn(own, F.coalesce(F.col(text), F.lit(""))).mapInArrow(_encode(model, remember, and_decode, own), schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def _decode(name: str, limit: int = 1 << 20):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("piece_ids"))
            ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
                part = column.slice(at, to - at)
                cuts = np.concatenate([[0], ends[at:to]]) - (ends[at - 1] if at else 0)
                cuts[0] = 0
                texts = load(name).decode(part.flatten().to_numpy(zero_copy_only=False), cuts)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])
                at = to

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with a column decoded: the text of piece_ids as the library's decode gives it (null ids: the empty text)."""
    return encoded.drop("decoded").mapInArrow(_decode(model), f"{_ddl(encoded.drop('decoded'))}, decoded string")
