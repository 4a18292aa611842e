import zlib

import duckdb
from pyspark.sql import functions as F

from relspark.llm import hilbert
from tests.test_entry import same


def test_curve_visits_every_cell_by_steps_of_one(spark):
    side = 1 << 4
    place = lambda k: (F.floor(F.col("id") / side**k) % side).cast("int")
    cells = spark.range(side**3).select(place(0).alias("x"), place(1).alias("y"), place(2).alias("z"))
    path = cells.withColumn("at", hilbert.curve_index([F.col("x"), F.col("y"), F.col("z")], 4)).orderBy("at").collect()
    assert [r.at for r in path] == list(range(side**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(path, path[1:]))


def check(out, rows, shards):
    raw = [(str(r["doc_id"]), (r["text"] or "").encode()) for r in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    by = {s: sorted((r.slot, r.curve) for r in out if r.shard == s) for s in range(shards)}
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all([s for s, _ in v] == list(range(len(v))) for v in by.values())
    order = [c for s in range(shards) for _, c in by[s]]
    assert order == sorted(order)


def test_operator(docs, rows, none):
    for shards in (1, 3, 16, 50):
        check(hilbert.sharded(docs, shards).collect(), rows, shards)
    assert hilbert.sharded(none).count() == 0


def test_query(spark, sf):
    out = hilbert.op9_hilbert(spark, sf).collect()
    check(out, [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 16)
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def grid(spark, n, step):
    """n rows of 16 lengths, 16 sources and n / step languages."""
    lang, source = f"concat('l', lpad(cast(id div {step} AS string), 2, '0'))", "concat('s', lpad(cast(id div 16 % 16 AS string), 2, '0'))"
    return spark.range(n).selectExpr("id AS doc_id", "repeat('x', cast(pow(2, id % 16) AS int)) AS text", f"{source} AS source", f"{lang} AS lang")


def test_shards_are_narrow_in_every_dimension(spark):
    df = grid(spark, 4096, 256)
    distinct = [F.countDistinct(c).alias(name) for c, name in (("source", "a"), ("lang", "b"), ("n_chars", "c"))]
    spans = hilbert.sharded(df, 64).groupBy("shard").agg(*distinct).collect()
    assert sum(max(r.a, r.b, r.c) for r in spans) / 64 < 11  # sorted by one dimension after the other, the last has 16 values in each shard


def test_written(docs, rows, tmp_path, spark):
    hilbert.written(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows) and len(list((tmp_path / "out").glob("shard=*"))) == 4


def test_files_can_be_skipped_in_every_dimension(spark, tmp_path):
    df = grid(spark, 8192, 512)
    path = str(tmp_path / "out")
    hilbert.written(df, path, 8, file_rows=100)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("source", "lang", "n_chars") for n, f in (("low", F.min), ("high", F.max))]
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(*bounds, F.count("*").alias("n")).collect()
    assert sum(f.n for f in files) == 8192 and max(f.n for f in files) <= 100
    for c, value in (("source", "s07"), ("lang", "l03"), ("n_chars", 256)):
        read = [f for f in files if f[f"low_{c}"] <= value <= f[f"high_{c}"]]
        assert len(read) < 0.45 * len(files), c


def test_query_against_sql(spark, sf):
    same(spark, sf, "op9", hilbert.op9_hilbert, hilbert.SQL)


def test_sql_on_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(hilbert.SQL).df()
    got = hilbert.op9_hilbert(spark, str(tmp_path)).toPandas()
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "curve"]
    rows = lambda df: sorted(map(str, df[columns].astype("Int64").itertuples(index=False)))
    assert rows(got) == rows(want)
