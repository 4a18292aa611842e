import random

from pyspark.sql import functions as F

from relspark.llm import common


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_components(spark, monkeypatch):
    r = random.Random(7)
    graphs = [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(500, k) for k in range(60)]]
    graphs.append([(r.randrange(300), r.randrange(300, 600)) for _ in range(200)])
    graphs.append([(k, 900 - k % 3) for k in range(100)] + [(5, 1000), (1000, 1001)])
    for hub in (common.HUB, 3):
        monkeypatch.setattr(common, "HUB", hub)
        for edges in graphs:
            got = sorted(tuple(x) for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect())
            assert got == roots(edges)


def test_ranked(spark):
    r = random.Random(8)
    rows = [(r.choice([None, 1, 1, 1, 2, 3]), r.randrange(5), r.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, j int, w long")
    out = sorted(common.ranked(df, [F.col("k").asc_nulls_last(), F.col("j"), F.col("w")], ["w"], deal=2).collect(), key=lambda x: x["rank"])
    assert [x["rank"] for x in out] == list(range(500))
    assert [(x.k, x.j, x.w) for x in out] == sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
    assert [x.before_w for x in out] == [sum(y.w for y in out[:k]) for k in range(500)]
    assert common.ranked(df.limit(0), [F.col("k")], ["w"]).count() == 0


def test_sized(spark):
    told = lambda df, most: "broadcast" in common.sized(df, most)._jdf.queryExecution().analyzed().toString().lower()
    assert told(spark.range(5), 80) and not told(spark.range(6), 80) and told(spark.range(0), 0)
    texts = spark.createDataFrame([("x" * 100,), (None,), ("é",)], "t string")
    assert told(texts, 150) and not told(texts, 149)


def test_unused_names():
    assert common.unused(["size", "size_", "Rows"], "size", "rows", "rows") == ["size__", "rows_", "rows__"]
