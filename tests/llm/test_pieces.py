import math
import random

import pytest
import sentencepiece

from relspark.llm import pieces

MODEL = pieces.read_model()
CODER = pieces.loaded(MODEL)
TEXTS = ["", " ", "  a  b ", "Hello  world\n\tçüê 漢字 😀", "▁x ▁▁ y", "\n\n", "x" * 3000, "the " * 500, "naïve café — ½"]


def unigram(model):
    """The same model file with its type set to the one whose reference encoder searches by score."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(of, value):
        if isinstance(value, int):
            return number(of << 3) + number(value)
        fixed = len(value) == 4 and of in (10, 11)
        return number(of << 3 | (5 if fixed else 2)) + (b"" if fixed else number(len(value))) + value

    out = b""
    for of, value in pieces.fields(model):
        if of == 2:
            kept = ((a, x) for a, x in pieces.fields(value) if a != 3)
            value = number(3 << 3) + number(1) + b"".join(field(a, x) for a, x in kept)
        out += number(of << 3 | 2) + number(len(value)) + value
    return out


def best(word):
    """The score of the best cut, by trying every piece at every place."""
    scores = [0.0]
    for end in range(1, len(word) + 1):
        options = [scores[a] + CODER.scores[word[a:end]] for a in range(end) if word[a:end] in CODER.scores]
        if word[end - 1] not in CODER.scores:
            options.append(scores[end - 1] + CODER.unknown)
        scores.append(max(options))
    return scores[-1]


def total(ids, coder=CODER):
    """The score of ids; bytes stand for unknown characters."""
    score, held = 0.0, b""
    for i in ids:
        p, _, kind = coder.pieces[i]
        if kind == pieces.BYTE:
            held += bytes([int(p[3:5], 16)])
        else:
            score += coder.scores[p]
    return score + coder.unknown * len(held.decode())


def test_cut_is_the_best():
    r = random.Random(3)
    for _ in range(300):
        word = "▁" * r.randint(0, 2) + "".join(r.choices("thenatiogçé漢😀\t", k=r.randint(1, 14)))
        ids = CODER.cut(word)
        assert total(ids) == pytest.approx(best(word)) and b"".join(CODER.bytes_of[i] for i in ids).decode() == word.replace("▁", " ")


def test_whole_texts_equal_the_best_cut_of_the_whole():
    for text in ["the cat sat on the mat", " a  b", "one\ntwo three"]:
        assert total(CODER.encode(text).tolist()) == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_scores_equal_the_reference_lattice():
    reference, own = sentencepiece.SentencePieceProcessor(model_proto=unigram(MODEL)), pieces.Pieces(unigram(MODEL))
    assert own.scores["▁the"] == dict((p, s) for p, s, _ in own.pieces)["▁the"]  # as the file has them
    for text in ["the cat", "tokenization works", "worthless", "an example of words"]:
        ids = reference.nbest_encode_as_ids(text, 5)[0]
        assert total(ids, own) == total(own.encode(text).tolist(), own)


def test_ranks_become_probabilities(spark):
    """Scores of a BPE model are a distribution, in order of rank, and texts take about as many pieces as by merging in order."""
    assert sum(math.exp(s) for s in CODER.scores.values()) == pytest.approx(1) and CODER.scores["▁t"] > CODER.scores["▁the"] > CODER.scores["梦"]
    reference = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    own, merged = (sum(len(encode(t)) for t in texts) for encode in (CODER.encode, reference.encode))
    assert own <= 1.02 * merged


def test_round_trip():
    for text in TEXTS:
        assert CODER.decode(CODER.encode(text).tolist()) == text


def test_operator(spark, docs, rows, none):
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = sorted(((r.doc_id, r.decoded, tuple(r.ids)) for r in out.collect()), key=str)
    assert got == sorted(((r["doc_id"], r["text"] or "", tuple(CODER.encode(r["text"]).tolist())) for r in rows), key=str)
    assert pieces.encode(none, MODEL).count() == 0


def test_query(spark, sf):
    out = pieces.op3_sentencepiece(spark, sf)
    assert out.count() == 200 and out.filter("NOT lossless OR n_tokens != size(ids)").count() == 0
