import re
from collections import Counter

import pytest

from relspark.llm import mixing
from tests.test_entry import same


def test_query(spark, sf):
    same(spark, sf, "op1", mixing.op1_mixing, mixing.SQL)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, share, most):
    """Targets by raising the level in small steps of full sources."""
    want, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in fixed}
        if not rest:
            return fixed
        level = (want - sum(fixed.values())) / sum(rest.values())
        over = [s for s, w in rest.items() if level * w > most * sizes[s]]
        if not over:
            return fixed | {s: level * w for s, w in rest.items()}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_copies(docs, rows):
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["copies"] <= 2
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(5)).collect())


def test_taken_words_are_near(spark):
    text, source = "repeat('w ', cast(1 + id % 300 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source"
    rows = spark.range(4000).selectExpr("id AS doc_id", text, source)
    taken = mixing.mix(rows).selectExpr("source", "target", "copies * size AS taken").groupBy("source", "target").sum("taken").collect()
    assert len(taken) == 6 and all(abs(r[2] - r.target) <= 600 for r in taken)


def test_rows_of_the_mix(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want


def test_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_any_column_names_and_repeated_rows(spark):
    """Columns called like what the operator makes; 3000 rows that are equal in everything among others."""
    schema = "doc_id long, text string, source string, size_ int, rows_ int, id_ int, copies int, target int, a int, n int, take_ int, words_ int"
    rest = (1, 2, 3, 4, 5, 6, 7, 8, 9)
    rows = [(7, "w w w", "hot", *rest)] * 3000 + [(k, "w " * (k % 9 + 1), f"s{k % 2}", *rest) for k in range(500)]
    rows += [(7, "w w w", "hot", *rest[:-1], 0), (None, None, None, *rest)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    assert Counter({}) + sum((Counter({(k[0], k[2], size(k[1])): n}) for k, n in got.items()), Counter()) == +want
    assert set(got) <= set(rows) and all(n <= 2 * rows.count(k) for k, n in got.items())


def test_words_near_the_target_on_the_documents(spark):
    """The worst source of the next scale is off by less than its largest document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = mixing.mix(docs).selectExpr("source", "target", "size", "copies * size AS taken")
    by = taken.groupBy("source", "target").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= r["max(size)"] for r in by)
