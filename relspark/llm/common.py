"""Helpers that several operators share: cutting lineage, sized broadcasts, global ranks, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_folder

#: Bytes up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Neighbours of a node, beyond which its edges are joined apart.
HUB = 200
#: Rows of whole texts that a Python worker gets at a time.
BATCH = 500
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage; lost executors then cost a reread only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def width(df: DataFrame) -> Column:
    """About as many bytes as a row takes in memory."""
    total = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total.cast("long")


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if all its rows, measured, take at most ``most`` bytes; else as it is: the join then shuffles both
    sides and AQE splits skewed partitions. ``df`` has scalar columns and is read twice, so it should be cheap or cut."""
    return F.broadcast(df) if (df.agg(F.sum(width(df))).first()[0] or 0) <= most else df


def unused(taken: Sequence[str], *names: str) -> list[str]:
    """These names, with underscores behind them until no column in ``taken`` is called so."""
    have = {c.lower() for c in taken}
    found = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        found.append(name)
    return found


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, for Python workers: whole texts can be long, so a worker gets ``BATCH`` rows at a time unless the session asks for fewer.
    This is a setting of the session, read when the plan runs; it is the number of rows held at once, not a limit on rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), rank: str = "rank", deal: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (0, 1, … in ``order`` over all rows) and ``before_<c>`` (sum of c over the rows before) for each of ``sums``.

    Rows are dealt by range, so a hot key is spread as long as ``order`` tells its rows apart; each range is numbered by itself
    and shifted by the totals of the ranges before it (one row per range, so their running sum is small). The dealt rows
    are cut first, because a second sampling could draw the ranges elsewhere. ``deal``: so many columns of ``order`` deal the rows; the
    driver samples these, so long texts should not be among them."""
    dealt = cut(df.repartitionByRange(partitions(df.sparkSession), *order[:deal]).withColumn("range_", F.spark_partition_id()))
    totals = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"), *[F.sum(c).alias(f"sum_{c}_") for c in sums])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    shifts = totals.select(F.col("range_"), shift("rows_").alias("rows_"), *[shift(f"sum_{c}_").alias(f"sum_{c}_") for c in sums])
    inside = Window.partitionBy("range_").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{c}": F.col(f"sum_{c}_") + F.coalesce(F.sum(c).over(running), F.lit(0)) for c in sums}
    return (
        dealt.join(F.broadcast(shifts), "range_")  # a row per range: at most spark.sql.shuffle.partitions
        .withColumn(rank, F.col("rows_") + F.row_number().over(inside) - 1)
        .withColumns(before)
        .drop("range_", "rows_", *[f"sum_{c}_" for c in sums])
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it is connected with.

    Alternates large-star and small-star steps until the edges stay the same. A step is an aggregation with map-side
    combine and an equi-join. A node with over ``HUB`` neighbours would gather them in one task of the join; such nodes, at most a
    ``HUB``-th of the edges, are joined apart, by broadcast if they are few."""

    def star(e: DataFrame, both: bool) -> DataFrame:
        flip = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        e = e.union(flip) if both else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")))
        hubs = sized(least.filter(F.col("n") > HUB).select("u", "m"))
        few = e.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= HUB), "u").select("u", "v", "m")
        far = e.join(hubs, "u").select("u", "v", "m").union(few)
        to_least = (far.filter("v > u") if both else far).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = to_least if both else to_least.union(least.select("u", F.col("m").alias("v")))
        return moved.filter("u != v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(edges.filter("u != v").distinct())
    seen = mark(edges)
    while seen[0]:
        edges = cut(star(star(edges, True), False))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
