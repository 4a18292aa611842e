"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 UTF-8 bytes ends a piece wherever it is -1 modulo the block size; each piece's hash gives one of 64
characters. The fingerprint holds the block size (3 x 2^k, so that there are about 32 to 64 pieces) and the signatures for it and for twice
it; the 64th character stands for the rest of the text. Two fingerprints are compared, where their block sizes are compatible (equal, or one
twice the other), by the edit distance of the signatures (insertion and deletion cost 1, substitution 2); without a common run of 7
characters (in signatures of under 28, a quarter of the shorter one) they are unlike.

Each document also meets its next one, in descending doc_id. Rows are dealt and sorted by range once; in a range the next row follows. Only the
last row of each range waits: the ranges' numbers tell which range comes next, and these rows (one per range) join its first text.

Defined cases: null is the empty text, whose fingerprint is ``3::``; equal texts have equal fingerprints and likeness 1; a lone document is its own next; rows
that repeat a doc_id stand by a hash of the text, null ids last; an empty table gives an empty result; columns other than doc_id and text are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, in_small_batches, partitions, table
from .shingles import P, P_INVERSE, mixed, powers

WINDOW, LENGTH, LEAST_BLOCK, COMMON = 7, 64, 3, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(raw: np.ndarray) -> np.ndarray:
    """For each byte, a 32-bit hash of the last ``WINDOW`` bytes: their sum, their weighted sum and a shifted mix."""
    n = len(raw)
    padded = np.r_[np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32)]
    plain, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        plain += part * np.uint32(WINDOW + 1 - back)
        shifted ^= part << np.uint32(5 * back) if 5 * back < 32 else part
    return plain + shifted


def signature(ends: np.ndarray, sums: np.ndarray) -> str:
    """A character for each piece; ``ends`` are where pieces end, ``sums`` the running sums of the bytes' powers."""
    n = len(sums) - 1
    stops = np.r_[ends[: LENGTH - 1], n] if not len(ends) or ends[min(len(ends), LENGTH - 1) - 1] < n else ends[: LENGTH - 1]
    if not n:
        return ""
    starts = np.r_[0, stops[:-1]]
    pieces = mixed((sums[stops] - sums[starts]) * powers(P_INVERSE, n + 1)[starts])
    return ALPHABET[(pieces >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n, block = len(raw), LEAST_BLOCK
    hashes = rolling(raw)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(P, n), dtype=np.uint64)]
    while block * LENGTH < n:
        block *= 2
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1) + 1
        if len(ends) >= LENGTH // 2 - 1 or block == LEAST_BLOCK:
            break
        block //= 2
    twice = ends[hashes[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(ends, sums)}:{signature(twice, sums)}"


def distance(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b, by a bit-parallel longest common subsequence."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) + len(b) - 2 * (len(a) - state.bit_count())


def likeness_of(a: str, b: str) -> float:
    a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in (a, b))
    k = min(COMMON, max(1, min(len(a), len(b)) // 4))
    if {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if one == other:
        return 1.0
    (block, a, aa), (block_, b, bb) = one.split(":"), other.split(":")
    if block == block_:
        return max(likeness_of(a, b), likeness_of(aa, bb))
    if int(block) == 2 * int(block_):
        return likeness_of(a, bb)
    if int(block_) == 2 * int(block):
        return likeness_of(aa, b)
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    made = F.pandas_udf(lambda texts: texts.map(fingerprint).astype("object"), "string")
    return in_small_batches(docs).select("doc_id", made("text").alias("fingerprint"))


COLUMNS = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double",
}


def compared(doc_id, text: str, own: str, after: str, next_own: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    of_edited = own if edited == text else fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own, of_edited, likeness(own, of_edited), likeness(own, next_own)


def with_next(docs: DataFrame) -> DataFrame:
    """Every row compared with its edited text and the next document."""
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # not the text: the driver samples what deals the rows
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    names = [*COLUMNS, "range_", "text", "head"]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = head = None
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                own = last[2] if last and last[1] == text else fingerprint(text)
                head = text if head is None else head
                if last:
                    out.append((*compared(*last, text, own), None, None, None))
                last = doc_id, text, own
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64", "range_": "Int64"})
        if last:
            wait = (last[0], *[None] * 6, TaskContext.get().partitionId(), last[1], head)
            yield pd.DataFrame([wait], columns=names).astype({"doc_id": "Int64", "n_chars": "Int64", "range_": "Int64"})

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["head"], strict=True)
            rows = [compared(d, t, fingerprint(t), h, fingerprint(h)) for d, t, h in each]
            yield pd.DataFrame(rows, columns=list(COLUMNS)).astype({"doc_id": "Int64"})

    schema = ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())
    met = cut(in_small_batches(dealt).mapInPandas(inside, f"{schema}, range_ long, text string, head string"))
    waiting = met.filter("range_ IS NOT NULL")
    # Numbers only, one per range: at most spark.sql.shuffle.partitions. After the last range comes the first.
    ranges = Window.orderBy("range_")
    first = F.first("range_").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order = waiting.select("range_", F.coalesce(F.lead("range_").over(ranges), first).alias("next_"))
    heads = waiting.select(F.col("range_").alias("next_"), "head")
    last = waiting.select("range_", "doc_id", "text").join(order, "range_").join(heads, "next_").select("doc_id", "text", "head")
    return met.filter("range_ IS NULL").select(*COLUMNS).union(in_small_batches(last).mapInPandas(across, schema))


def op7_fuzzy_hash(spark, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
