import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of random words; toxic ones hold words of two families, poor ones shout."""
    r = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        w = ["".join(r.choices("abcdefg", k=r.randint(2, 6))) for _ in range(r.randint(20, 200))]
        toxic, poor = k % 7 == 0, k % 5 == 0
        if toxic:
            for _ in range(3 + len(w) // 30):
                w[r.randrange(len(w))] = r.choice(["zounds", "vermin" + r.choice("abcdefgh")])
        text = " ".join(w)
        rows.append((k, text.upper() + "!!" if poor else text))
        labels.append((k, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    truth = {r.doc_id: r for r in labels.filter("doc_id % 2 = 1").collect()}
    wrong = [r for r in toxicity.score(docs, model).collect() if r.doc_id in truth and (r.p_toxic >= model["limits"][1]) != truth[r.doc_id].toxic]
    poor = [r for r in toxicity.score(docs, model).collect() if r.doc_id in truth and (r.p_quality >= model["limits"][0]) != truth[r.doc_id].quality]
    assert len(wrong) <= 6 and len(poor) <= 6
    kept = toxicity.clean(docs, labels)
    toxic = labels.filter("toxic = 1").select("doc_id")
    assert kept.columns == docs.columns and kept.join(toxic, "doc_id").count() <= 2 and kept.count() >= 505


def test_later_models_see_earlier_predictions():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3)).astype(np.float32)
    first = (x[:, 0] > 0).astype(float)
    (a, _), (b, _) = toxicity.fitted(x, np.c_[first, first], np.arange(400) % 4)
    assert len(a) == 4 and len(b) == 5 and b[3] > 0


def test_logistic_by_gradient():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    y = (x @ [1, -2, 0.5, 0] + r.normal(size=300) > 0.3).astype(float)
    w = toxicity.logistic(x, y, penalty=1.0, steps=3000)
    p = toxicity.predicted(x, w)
    assert np.abs(np.r_[x.T @ (p - y) + w[:-1], (p - y).sum()]).max() < 0.05


def test_odd_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, None, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 30 and all(0 < r.p_toxic < 1 for r in out)
    same = {r.p_toxic for r in out if r.doc_id in (1, 6, 7)}
    assert len(same) == 1
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_query(spark, sf):
    out = toxicity.op5_toxicity(spark, sf)
    assert out.count() == 200 and set(r.toxic for r in out.select("toxic").distinct().collect()) <= {0, 1}


def plainly(text, model):
    """The chain's probabilities, word by word from the fitted weights, without the operator's code."""
    text = text or ""
    words = re.findall(r"\w+", text.lower())
    seen = {}
    for w in words:
        for t in {w + "$", *[w[:k] for k in (4, 5, 6, 7, 8) if len(w) >= k]}:
            seen[t] = seen.get(t, 0) + 1
    n = max(1, len(words))
    often = max([words.count(w) for w in set(words)], default=0)
    capitals, letters = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text), sum(map(len, words))
    shape = [math.log(1 + n) / 4, letters / max(1, len(text)), capitals / max(1, len(text)), len(set(words)) / n, letters / n / 10, often / n]
    out = []
    for w in model["weights"]:
        x = [*[math.log(1 + seen.get(t, 0)) for t in model["vocabulary"]], *shape, *out, 1.0]
        assert len(x) == len(w)
        z = sum(a * b for a, b in zip(x, w))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def test_query_against_plain_scoring(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = toxicity.op5_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts) and len({r.toxic for r in out}) == 2
    for r in out:
        quality, toxic = plainly(texts[r.doc_id], model)
        assert abs(r.p_quality - quality) < 1e-4 and abs(r.p_toxic - toxic) < 1e-4
        assert r.toxic == (toxic >= model["limits"][1]) or abs(toxic - model["limits"][1]) < 1e-4


def test_no_texts_are_gathered(spark, sf, monkeypatch):
    """The one group that the models are fitted on holds vectors only."""
    from pyspark.sql.group import GroupedData

    grouped, seen = GroupedData.applyInPandas, []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: seen.extend(self._df.columns) or grouped(self, *a))
    toxicity.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    assert "shapes" in seen and "text" not in seen


def plain_tokens(text):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return {t for w in words for t in [w + "$", *[w[:k] for k in (4, 5, 6, 7, 8) if len(w) >= k]]}


def plain_choice(rows, most=400, least=5):
    """The words of (text, labels) by chi-square, with plain loops."""
    total, sums = len(rows), [sum(y[c] for _, y in rows) for c in range(2)]
    seen = {}
    for text, y in rows:
        for t in plain_tokens(text):
            n = seen.setdefault(t, [0, 0, 0])
            n[0] += 1
            n[1] += y[0]
            n[2] += y[1]
    found = {}
    for c in range(2):
        if not 0 < sums[c] < total:
            continue

        def chi(t):
            n, a = float(seen[t][0]), float(seen[t][1 + c])
            over = a * total - n * sums[c]
            return over * over * total / max(n * (total - n) * sums[c] * (total - sums[c]), 1.0)

        order = sorted((t for t in seen if seen[t][0] >= least), key=lambda t: (-chi(t), t.encode()))
        taken = 0
        for t in order[: 4 * most]:
            if taken < most and t not in found and not any(found.get(t[:k].rstrip("$")) == seen[t] for k in range(3, len(t))):
                found[t] = seen[t]
                taken += 1
    return sorted(found)


def plain_logistic(x, y):
    """The optimum by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    lean, w = np.r_[np.full(x.shape[1] - 1, 0.3), 1e-6], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(lean), x.T @ (p - y) + lean * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def plain_row(text, vocabulary):
    text = text or ""
    words = re.findall(r"\w+", text.lower())
    counts = {}
    for w in words:
        for t in plain_tokens(w):
            counts[t] = counts.get(t, 0) + 1
    n = max(1, len(words))
    often = max((words.count(w) for w in set(words)), default=0)
    capitals, letters = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text), sum(map(len, words))
    shape = [math.log(1 + n) / 4, letters / max(1, len(text)), capitals / max(1, len(text)), len(set(words)) / n, letters / n / 10, often / n]
    return [*[math.log(1 + counts.get(t, 0)) for t in vocabulary], *shape]


def test_chain_against_plain_loops(spark, sf):
    """The whole fit: words chosen inside folds, out-of-fold predictions of quality as an input of toxic, and both models."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic", F.pmod(F.xxhash64("text"), F.lit(4)).alias("fold")).collect()
    texts, y = [r.text for r in rows], np.array([[r.quality, r.toxic] for r in rows], float)
    folds = np.array([r.fold for r in rows])
    outside, models = np.zeros(y.shape), []
    sets = {held: plain_choice([(t, tuple(v)) for t, v, f in zip(texts, y, folds) if f != held]) for held in (0, 1, 2, 3, None)}
    for c in range(2):
        for held, vocabulary in sets.items():
            x = np.c_[np.array([plain_row(t, vocabulary) for t in texts]), outside[:, :c]]
            here = folds == held if held is not None else np.zeros(len(folds), bool)
            w = plain_logistic(x[~here], y[~here, c])
            if held is None:
                models.append(w)
            else:
                outside[here, c] = 1 / (1 + np.exp(-(np.c_[x[here], np.ones(here.sum())] @ w)))
    model = toxicity.train(docs, labels)
    assert model["vocabulary"] == sets[None]
    whole = {d.doc_id: d.text for d in docs.collect()}
    for r in toxicity.op5_toxicity(spark, sf).collect():
        x = plain_row(whole[r.doc_id], sets[None])
        quality = 1 / (1 + math.exp(-(np.r_[x, 1.0] @ models[0])))
        toxic = 1 / (1 + math.exp(-(np.r_[x, quality, 1.0] @ models[1])))
        assert abs(r.p_quality - quality) < 0.02 and abs(r.p_toxic - toxic) < 0.02


def test_copies_share_a_fold(spark):
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    folds = {}
    for r in toxicity.sampled(docs, labels, toxicity.CHAIN, 100).collect():
        folds.setdefault(r.text, set()).add(r.fold_)
    assert len(folds) == 5 and all(len(f) == 1 for f in folds.values())
