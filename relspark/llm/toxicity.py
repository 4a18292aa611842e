"""Toxicity by a classifier chain. A document is called toxic from the probability on that had the best F1 out of fold.

The chain's labels are predicted one after the other, each by a logistic regression that also sees the predictions before it. A later
model is trained with out-of-fold predictions of the earlier labels, so that it doesn't trust them more than it may when it
meets new rows. The labelled table has two labels: quality comes first, toxic sees its prediction.

Inputs of the models: log counts of chosen words and word beginnings, and the shape of the text (length, symbols, capitals,
repetition). The words are chosen by the chi-square statistic of their presence against each label. A fold's predictions come from a model
whose words, too, were chosen without that fold; folds go by a hash of the text, so that copies are in one.

Only the models are fitted on a bounded sample: the ``SAMPLE`` labelled rows with the least hash of doc_id. Every document is
scored over its whole text.

Defined cases: a null, empty or wordless text has no word counts and is scored by its shape; a null label counts as 0; of rows that repeat a
labelled doc_id the largest label counts; without labelled rows of both kinds a label's probability is the share of its ones; a null
doc_id is scored too; equal texts get equal scores; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, in_small_batches, table

CHAIN = ("quality", "toxic")
SAMPLE, CHOSEN, LEAST_DOCS, FOLDS = 8000, 400, 5, 4
#: Numbers that shape() gives.
SHAPES = 6
#: Lengths of word beginnings besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
WORD, CAPITAL = re.compile(r"\w+"), re.compile("[A-ZÀ-ÖØ-Þ]")


def tokens(word: str) -> list[str]:
    """Whole words carry a mark, so that they differ from beginnings."""
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def shape(text: str, words: Counter) -> list[float]:
    n, chars = max(1, sum(words.values())), max(1, len(text))
    letters = sum(len(w) * k for w, k in words.items())
    capitals = len(CAPITAL.findall(text))
    return [np.log1p(n) / 4, letters / chars, capitals / chars, len(words) / n, letters / n / 10, max(words.values(), default=0) / n]


def vector(text: str | None, places: dict[str, int], starts: dict[str, bool]) -> tuple[list[int], list[float], list[float]]:
    """Places and log counts of the chosen tokens in a text, and its shape."""
    text = text or ""
    words = Counter(WORD.findall(text.lower()))
    counts: Counter = Counter()
    for word, k in words.items():
        if word[:4] in starts:
            for t in tokens(word):
                if t in places:
                    counts[places[t]] += k
    return list(counts), [float(np.log1p(k)) for k in counts.values()], shape(text, words)


def chosen(sample: DataFrame, chain: Sequence[str], most: int = CHOSEN, least: int = LEAST_DOCS) -> list[list[str]]:
    """Up to ``most`` tokens a label, by chi-square: for each fold those that the other folds choose, and last those of all folds."""

    def present(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: list({x for w in set(WORD.findall((t or "").lower())) for x in tokens(w)}))

    distinct = F.pandas_udf(present, "array<string>")
    fold = lambda k: F.col("fold_") == k
    of_fold = [F.count_if(fold(k)).alias(f"n_{k}") for k in range(FOLDS)]
    of_fold += [F.coalesce(F.sum(F.when(fold(k), F.col(c))), F.lit(0)).alias(f"{c}_{k}") for c in chain for k in range(FOLDS)]
    words = in_small_batches(sample).select(*chain, "fold_", F.explode(distinct("text")).alias("token"))
    counts = cut(words.groupBy("token").agg(*of_fold, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    total = sample.agg(*of_fold).first()
    without = lambda held, what: [f"{what}_{k}" for k in range(FOLDS) if k != held]
    ranks = []
    for held in range(FOLDS + 1):
        rows = float(sum(total[x] for x in without(held, "n")))
        n, *ones = (sum((F.col(x) for x in without(held, what)), F.lit(0)) for what in ("n", *chain))
        for c, label in enumerate(chain):
            yes = float(sum(total[x] for x in without(held, label)))
            if 0 < yes < rows:
                a, b = ones[c].cast("double"), n.cast("double")
                over = a * rows - b * yes
                chi = over * over * rows / F.greatest(b * (rows - b) * yes * (rows - yes), F.lit(1.0))
                seen = F.array(*[x.cast("long") for x in (n, *ones)])
                ranks.append(F.struct(F.lit(held).alias("held"), F.lit(c).alias("label"), chi.alias("chi"), seen.alias("seen")))
    if not ranks:
        return [[] for _ in range(FOLDS + 1)]
    best = Window.partitionBy("held", "label").orderBy(F.desc("chi"), "token")
    ranked_ = counts.select("token", F.explode(F.array(*ranks)).alias("r")).select("token", "r.*").filter(F.col("seen")[0] >= least)
    # A bounded vocabulary: so many for each fold and label.
    found = ranked_.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= 4 * most).orderBy("held", "label", "at").collect()
    return [picked([r for r in found if r.held == held], most) for held in range(FOLDS + 1)]


def picked(rows: Sequence, most: int) -> list[str]:
    """The first ``most`` tokens of each label; of tokens that extend each other with equal counts, the shortest."""
    found: dict[str, list[int]] = {}
    taken: Counter = Counter()
    for r in rows:
        shorter = (found.get(r.token[:k].rstrip("$")) for k in range(3, len(r.token)))
        if taken[r.label] < most and r.token not in found and r.seen not in shorter:
            found[r.token] = r.seen
            taken[r.label] += 1
    return sorted(found)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 1500, enough: float = 2e-5) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by accelerated gradient steps that start anew where they overshoot; they
    end where no weight moves by more than ``enough``."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    lean = np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    y, lean = y.astype(x.dtype), lean.astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (float(np.linalg.norm(x.T @ (x @ v))) / 4 * 1.05 + penalty)
    w = z = np.zeros(x.shape[1], x.dtype)
    t = 1.0
    for _ in range(steps):
        now = z - rate * (x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) + lean * z)
        moved = now - w
        if float((z - now) @ moved) > 0:
            t = 1.0
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, w = now + (last - 1) / t * moved, now
        if np.abs(moved).max() < enough:
            break
    return w.astype(float)


def predicted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def dense(places, counts, shapes, n: int) -> np.ndarray:
    out = np.zeros((len(shapes), n + SHAPES), np.float32)
    for k, (p, c, s) in enumerate(zip(places, counts, shapes, strict=True)):
        out[k, np.asarray(p, int)] = c
        out[k, n:] = s
    return out


def limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which rows are called positive: the one with the best F1 on out-of-fold predictions."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    after = p[order][min(best + 1, len(y) - 1)]
    return float(np.clip((p[order][best] + after) / 2, 0.02, 0.98))


def fitted(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, used: Sequence[np.ndarray] | None = None) -> list[tuple[np.ndarray, float]]:
    """The chain's weights and limits; each label's model sees x and a column for each label before it. ``used``: the columns of x (true or
    false) that the model without each fold may see, and last those of the model of all folds; the others get no weight."""
    used = [np.ones(x.shape[1], bool)] * (FOLDS + 1) if used is None else list(used)
    models = []
    for y in labels.T:
        if y.min(initial=1) == y.max(initial=0) or not len(y):
            share = np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3)
            models.append((np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))], 0.5))
            outside = np.full(len(y), share)
        else:
            outside = np.empty(len(y))
            for k in np.unique(folds):
                here, own = folds == k, np.flatnonzero(used[k])
                other = logistic(x[~here][:, own], y[~here]) if not here.all() else None
                outside[here] = predicted(x[here][:, own], other) if other is not None else y.mean()
            own = np.flatnonzero(used[-1])
            w = np.zeros(x.shape[1] + 1)
            w[np.r_[own, x.shape[1]]] = logistic(x[:, own], y)
            models.append((w, limit(outside, y)))
        x = np.c_[x, outside.astype(x.dtype)]
        used = [np.r_[u, True] for u in used]
    return models


def sampled(docs: DataFrame, labels: DataFrame, chain: Sequence[str], sample: int) -> DataFrame:
    """text, labels, fold and a hash of up to ``sample`` labelled documents."""
    largest = [F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(c) for c in chain]
    rows = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_")).agg(*largest)
    rows = F.broadcast(cut(rows.withColumn("hash_", F.xxhash64("of_")).orderBy("hash_", "of_").limit(sample)))  # at most ``sample`` rows
    found = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("of_"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold_")
    return cut(found.select("of_", "hash_", "text", fold, *chain).orderBy("hash_", "of_", "text").limit(sample))


def train(docs: DataFrame, labels: DataFrame, chain: Sequence[str] = CHAIN, sample: int = SAMPLE) -> dict:
    rows = sampled(docs, labels, chain, sample)
    by_fold = chosen(rows, chain)
    vocabulary = sorted(set().union(*by_fold))
    places = {t: k for k, t in enumerate(vocabulary)}
    starts = beginnings(vocabulary)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [vector(t, places, starts) for t in pdf["text"]]
            at, counts, shapes = zip(*found, strict=True) if found else ((), (), ())
            yield pdf.drop(columns="text").assign(places=list(at), counts=list(counts), shapes=list(shapes))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash_", "of_"], ignore_index=True)
        x = dense(pdf["places"], pdf["counts"], pdf["shapes"], len(places))
        used = [np.r_[[t in own for t in vocabulary], np.ones(SHAPES, bool)].astype(bool) for own in map(set, by_fold)]
        models = fitted(x, pdf[list(chain)].to_numpy(float), pdf["fold_"].to_numpy(int), used)
        kept = np.flatnonzero(used[-1])
        weights = [m[np.r_[kept, np.arange(x.shape[1], len(m))]].tolist() for m, _ in models]
        return pd.DataFrame({"label": list(chain), "weights": weights, "limit": [limit for _, limit in models]})

    # One group of at most ``sample`` vectors, which have at most as many numbers as the vocabulary has words; the texts stay where they are.
    narrow = rows.select("of_", "hash_", "fold_", *chain, "text")
    types = ", ".join(f"{c} {t}" for c, t in narrow.drop("text").dtypes)
    narrow = in_small_batches(narrow).mapInPandas(vectors, f"{types}, places array<int>, counts array<double>, shapes array<double>")
    found = {r["label"]: r for r in narrow.groupBy().applyInPandas(fit, "label string, weights array<double>, limit double").collect()}
    unfit = lambda k: {"weights": [*[0.0] * (len(by_fold[-1]) + SHAPES + k), -6.9], "limit": 0.5}
    of = [found.get(c, unfit(k)) for k, c in enumerate(chain)]
    weights = [np.array(m["weights"]) for m in of]
    return {"chain": list(chain), "vocabulary": by_fold[-1], "weights": weights, "limits": [m["limit"] for m in of]}


def beginnings(vocabulary: Sequence[str]) -> dict[str, bool]:
    return {t.rstrip("$")[:4]: True for t in vocabulary}


def probabilities(text: str | None, model: dict, places: dict[str, int], starts: dict[str, bool]) -> list[float]:
    """The chain's probabilities for a text, in its order."""
    at, counts, shapes = vector(text, places, starts)
    n, before = len(places), []
    for w in model["weights"]:
        m = n + len(shapes)
        z = float(w[at] @ counts if at else 0) + float(w[n:m] @ shapes) + float(w[m:-1] @ before) + w[-1]
        before.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return before


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_<label> for each label of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded vocabulary and its weights

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        places = {t: k for k, t in enumerate(m["vocabulary"])}
        starts = beginnings(m["vocabulary"])
        for pdf in batches:
            rows = [probabilities(text, m, places, starts) for text in pdf["text"]]
            found = {f"p_{c}": [r[k] for r in rows] for k, c in enumerate(m["chain"])}
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **found})

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in model["chain"])
    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(scored, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the chain calls toxic, in one pass over the texts. Columns may be called anything; rows that are
    equal in text stay or go together; a null or empty text is judged by its shape, like any other."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stay(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        places = {t: k for k, t in enumerate(m["vocabulary"])}
        starts = beginnings(m["vocabulary"])
        for series in batches:
            yield series.map(lambda t: probabilities(t, m, places, starts)[-1] < m["limits"][-1]).astype(bool)

    return in_small_batches(docs).filter(F.pandas_udf(stay, "boolean")("text"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    return score(docs, model).withColumn("toxic", (F.col("p_toxic") >= model["limits"][-1]).cast("int"))
