"""SentencePiece encoding and decoding with the pieces and scores of a model file.

The text, with a space before it and spaces written as U+2581, is cut into pieces so that the sum of their scores is largest. An
Aho-Corasick automaton over all pieces reads the text once; at each position its output links give the pieces that end there, longest
first, and each relaxes the best score there (Viterbi). Characters without a piece of their own cost the least score less 10 and
become byte pieces. A unigram model's scores stand as the file has them. A BPE model's are ranks, whose sum means nothing, so they become
log-probabilities by the law of Zipf and Mandelbrot, p ~ 1 / (rank + ``FLAT``): nothing is trained, and the best cut is the likeliest one
under that law, which can differ from the one that merging in order would make.

No piece holds a space behind another character (the file is checked), so a text is cut independently at the start of each run of spaces and the cuts of
short words are kept. Decoding gives back every text exactly: a U+2581 of the text itself is written as bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; a text of blanks has pieces of blanks; long texts, even without any
space, are encoded whole in linear time; equal rows get equal ids; columns other than doc_id and text are not read."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longest word and number of words kept with their ids in each worker.
KEPT_CHARS, KEPT_WORDS = 32, 1 << 18
INFINITE = float("inf")
#: Added to the ranks of a BPE model, and the number that the file has for that type.
FLAT, BPE = 100, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        by_rank = False
        for of, value in fields(model):
            if of == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif of == 2:
                by_rank = dict(fields(value)).get(3) == BPE
        usual = {p: (i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        if by_rank:
            whole = math.log(sum(1 / (FLAT - s) for _, s in usual.values()))
            usual = {p: (i, -math.log(FLAT - s) - whole) for p, (i, s) in usual.items()}
        self.scores = {p: s for p, (_, s) in usual.items()}
        self.single = {p for p in usual if len(p) == 1}
        self.unknown = min(self.scores.values()) - 10
        self.byte_ids = {bytes([int(p[3:5], 16)]): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in usual):
            raise ValueError("a piece crosses a line or the start of a word")
        self.automaton = ahocorasick.Automaton()
        for p, (i, s) in usual.items():
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.bytes_of = [self.stands_for(p, kind) for p, _, kind in self.pieces]
        self.kept: dict[str, bytes] = {}
        self.words = re.compile(f"{SPACE}| *[^ \n{SPACE}]+| +|\n")

    @staticmethod
    def stands_for(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind in (UNKNOWN, CONTROL, UNUSED) else piece.replace(SPACE, " ").encode()

    def cut(self, word: str) -> list[int]:
        """Ids of the best cut of ``word``, in which spaces are written as U+2581."""
        best, back, use = [0.0, *[-INFINITE] * len(word)], [0] * (len(word) + 1), [-1] * (len(word) + 1)
        if self.single.issuperset(word):
            for end, (length, score, piece) in self.automaton.iter(word):
                score += best[end + 1 - length]
                if score > best[end + 1]:
                    best[end + 1], back[end + 1], use[end + 1] = score, end + 1 - length, piece
        else:
            self.cut_unknown(word, best, back, use)
        ids: list[int] = []
        n = len(word)
        while n:
            start = back[n]
            ids += [use[n]] if use[n] >= 0 else [self.byte_ids[bytes([b])] for b in reversed(word[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        return ids[::-1]

    def cut_unknown(self, word: str, best: list[float], back: list[int], use: list[int]) -> None:
        """The same for a word with characters that have no piece of their own."""
        found = self.automaton.iter(word)
        end, match = next(found, (len(word), None))
        for i, char in enumerate(word):
            while end == i:
                length, score, piece = match
                score += best[i + 1 - length]
                if score > best[i + 1]:
                    best[i + 1], back[i + 1], use[i + 1] = score, i + 1 - length, piece
                end, match = next(found, (len(word), None))
            if char not in self.single and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1], use[i + 1] = best[i] + self.unknown, i, -1

    def word_ids(self, word: str) -> bytes:
        """The ids of a word as 32-bit numbers, kept for the next time."""
        ids = self.kept.get(word)
        if ids is None:
            own = [self.byte_ids[bytes([b])] for b in SPACE.encode()] if word == SPACE else self.cut(word.replace(" ", SPACE))
            ids = array("i", own).tobytes()
            if len(word) <= KEPT_CHARS:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = self.words.findall(f" {text}")
        ids = list(map(self.kept.get, words))
        if None in ids:
            ids = [self.word_ids(w) if known is None else known for w, known in zip(words, ids, strict=True)]
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, made once in each worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ids array<int>, in place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of a vocabulary file
    kept = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            ids = [pieces.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ids"])

    return in_small_batches(docs.select(*kept)).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` with decoded string: the text that its ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField("decoded", T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_pylist()])
            texts = [pieces.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return in_small_batches(encoded.select(*kept)).mapInArrow(decoded, schema)


def op3_sentencepiece(spark, sf_dir: str, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 (of the text decoded from them), lossless (it is the document's)."""
    from pyspark.sql import functions as F

    model = read_model(path)
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    lossless = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless")
    return both.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), lossless)
