import hashlib
import random

from relspark.llm import fuzzy_hash as f
from tests.llm.conftest import words


def slow_fingerprint(text):
    """The same by going through the bytes one at a time."""
    raw = (text or "").encode()
    window, hashes = [0] * f.WINDOW, []
    for b in raw:
        window = [b, *window[:-1]]
        shifted = 0
        for k, c in enumerate(window):
            shifted ^= (c << 5 * k if 5 * k < 32 else c) & 0xFFFFFFFF
        hashes.append((sum(c * (f.WINDOW + 1 - k) for k, c in enumerate(window)) + shifted) & 0xFFFFFFFF)

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & (1 << 64) - 1
        return x ^ x >> 33

    def signature(block):
        out, start = "", 0
        ends = [k + 1 for k, x in enumerate(hashes) if x % block == block - 1 and k + 1 < len(raw)][: f.LENGTH - 1]
        for end in [*ends, len(raw)] if raw else []:
            piece = sum((b + 1) * pow(int(f.P), k, 1 << 64) for k, b in enumerate(raw[start:end])) & (1 << 64) - 1
            out, start = out + chr(f.ALPHABET[mixed(piece) >> 58]), end
        return out

    block = f.LEAST_BLOCK
    while block * f.LENGTH < len(raw):
        block *= 2
    while block > f.LEAST_BLOCK and sum(x % block == block - 1 for x in hashes) < f.LENGTH // 2 - 1:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprints_equal_the_slow_ones():
    for text in (None, "", "a", "abcabc", "é漢😀", words(9, 1), words(300, 2), words(3000, 3), "Of " * 900):
        assert f.fingerprint(text) == slow_fingerprint(text)


def test_distance():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 9))) for _ in "ab")
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + 2 * (x != y))
        assert f.distance(a, b) == table[-1][-1]


def test_likeness():
    text = words(900, 4)
    changed = text[:2000] + "some other words" + text[2000:]
    own = f.fingerprint(text)
    assert f.likeness(own, own) == 1 and f.likeness(own, f.fingerprint(changed)) > 0.8 and f.likeness(own, f.fingerprint(words(900, 5))) < 0.2
    assert f.likeness(own, f.fingerprint(text + text[: len(text) // 3])) > 0.4 and f.likeness("3::", own) == 0


def test_operator(docs, rows, none):
    out = sorted((tuple(r) for r in f.with_next(docs).collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))  # rows that repeat an id are equal here
    want = []
    for k, r in enumerate(ordered):
        text, after = r["text"] or "", ordered[(k + 1) % len(ordered)]["text"] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other = f.fingerprint(text), f.fingerprint(edited)
        near = f.likeness(own, other), f.likeness(own, f.fingerprint(after))
        want.append((r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, *near))
    assert out == sorted(want, key=str)
    assert f.with_next(none).count() == 0 and f.fingerprints(docs).count() == len(rows)
    assert [r.near_next for r in f.with_next(docs.filter("doc_id = 4")).collect()] == [1.0]


def test_query(spark, sf):
    out = f.op7_fuzzy_hash(spark, sf)
    assert out.count() == 200 and out.filter("near_edited < 0 OR near_edited > 1 OR near_next < 0 OR near_next > 1").count() == 0
