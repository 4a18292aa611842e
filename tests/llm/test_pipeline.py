from collections import Counter

import corpus_pipeline
from relspark.llm import mixing, ngram_join, pieces, toxicity

from .test_mixing import filled, size
from .test_ngram_join import brute
from .test_toxicity import plainly


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(spark, stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            assert counts[-1] < counts[-2]
        if name == "ngram_join":
            assert counts[-1] < counts[-2] and ngram_join.links(docs).filter("n_links > 0").count() == 0
    assert counts[3] > counts[2] and counts[4] == counts[3] and docs.columns == [*columns, "ids"]
    assert docs.filter("size(ids) = 0 AND length(text) > 0").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == counts[4]


def test_first_stages_against_brute_force(spark, sf):
    """Toxicity by plain scoring with the fitted weights, and near duplicates by all pairs."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = corpus_pipeline.written(spark, corpus_pipeline.safe(spark, docs, sf), "clean")
    want = sorted((r.doc_id, r.text) for r in docs.collect() if plainly(r.text, model)[-1] < model["limits"][-1])
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == want and len(want) < docs.count()
    least = {i: c for i, c, _ in brute(want)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, clean, sf).collect()) == sorted(i for i, c in least.items() if i == c)


def test_mixing_stage_against_a_plain_mix(spark, sf):
    """Documents in order of size, expected copies summed from an offset, one copy at each integer crossed; the best of 16 offsets."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = Counter(r.doc_id for r in corpus_pipeline.mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect())
    totals = Counter()
    for d in docs:
        totals[d["source"]] += size(d["text"])
    order = sorted(totals)
    targets = filled(totals, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    sources = spark.createDataFrame([(s,) for s in order], "source string")
    first = {r.source: r.u for r in sources.select("source", mixing.offset("source", mixing.SEED).alias("u")).collect()}
    want = Counter()
    for s in order:
        own = sorted((size(d["text"]), d["doc_id"]) for d in docs if d["source"] == s)
        each = targets[s] / totals[s]
        trials = []
        for k in range(mixing.TRIALS):
            at = [int((p * each + first[s] + k / mixing.TRIALS) // 1) for p in range(len(own) + 1)]
            copies = [b - a for a, b in zip(at, at[1:])]
            trials.append((abs(sum(c * n for c, (n, _) in zip(copies, own)) - targets[s]), k, copies))
        for c, (_, doc_id) in zip(min(trials)[2], own):
            want[doc_id] += c
    assert got == +want


def test_stages_on_odd_rows(spark, sf, docs, rows, none):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names, for each stage by itself."""
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["size"], r["rank"])
    given = Counter(map(key, rows))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + (["ids"] if name == "sentencepiece" else [])
        got = Counter(key(r.asDict()) for r in out.collect())
        assert set(got) <= set(given)
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            stays = {t: plainly(t, model)[-1] < model["limits"][-1] for t in {r["text"] for r in rows}}
            assert got == Counter({k: n for k, n in given.items() if stays[k[1]]})
        if name == "ngram_join":
            classes = {i: c for i, c, _ in brute([(r["doc_id"], r["text"]) for r in rows])}
            assert {k[0] for k in got} == {i for i, c in classes.items() if i is None or i == c} and max(got.values()) == 1
        if name == "mixing":
            words = Counter()
            for r in mixing.mix(docs).collect():
                words[r.doc_id, r.source] += r.copies
            assert sum((Counter({(k[0], k[3]): n}) for k, n in got.items()), Counter()) == +words
        if name == "sentencepiece":
            coder = pieces.loaded(pieces.read_model())
            assert got == given and all(r.ids == coder.encode(r.text).tolist() for r in out.collect())
        assert stage(spark, none, sf).count() == 0
