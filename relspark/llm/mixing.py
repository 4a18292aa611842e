"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The documents of a source stand in order of size, the
expected copies are summed along that order from a random offset, and a document is emitted once for every integer that the
sum crosses at it. In order of size, each run of similar documents gives its share, so the words taken stay within
about one large document of the target. Of the random offset and those ``1 / TRIALS`` apart from it, each source takes the one whose words come nearest
to its target, which helps sources of few documents.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has target 0 and gives
no copies; documents of equal size stand by id, and rows equal in both are interchangeable; an empty table gives an empty
result; other columns pass through untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, ranked, sized, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED, TRIALS = 17, 16
#: Copies of one row that a task writes at once, where rows that are equal in all columns share their copies.
RUN = 1000


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (the words of each document) and ``more`` columns."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def targets(sized_docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, docs_, first_ (rank of its first document), target.

    Weights repeat along the sources in code-point order. Targets fill up evenly by weight (target = level x weight) and stop at
    ``most`` times their source's size; the level is the first, in order of the size a unit of weight can bear, that the next
    source bears."""
    per = cut(sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs_")))
    per = ranked(per, [F.col("source").asc_nulls_last()], ["docs_"], "place_").withColumnRenamed("before_docs_", "first_")
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place_") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight_", choose).withColumn("cap_", most * F.col("source_size"))
    per = cut(per.withColumn("bears_", F.col("cap_") / F.col("weight_")))
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight_"), F.lit(0.0))).first()
    steps = ranked(per, [F.col("bears_"), F.col("place_")], ["cap_", "weight_"], "step_")
    level = (F.lit(share * size) - F.col("before_cap_")) / (F.lit(weight) - F.col("before_weight_"))
    level = steps.withColumn("level_", level).filter("level_ <= bears_").agg(F.min_by("level_", "step_")).first()[0]
    full = F.lit(float("inf") if level is None else level) * F.col("weight_")
    return per.select("source", "source_size", "docs_", "first_", F.least("cap_", full).alias("target"))


def offset(source, seed: int):
    """A number in [0, 1) that depends on the source and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, more: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of ``docs``, and its ``more`` columns (of other names)."""
    narrow = cut(sizes(docs, *more))
    per = targets(narrow, weights, share, most)
    placed = ranked(narrow, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], rank="rank_")
    per = sized(per.withColumnRenamed("source", "source_"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    position = lambda at, trial: F.floor(at * F.col("each_") + F.col("offset_") + trial / F.lit(float(TRIALS)))
    taken = lambda trial: position(F.col("at_") + 1, trial) - position(F.col("at_"), trial)
    placed = cut(
        placed.join(per, placed.source.eqNullSafe(per.source_))
        .withColumn("each_", each)
        .withColumn("offset_", offset(F.col("source"), seed))
        .withColumn("at_", F.col("rank_") - F.col("first_"))
        .select("doc_id", "source", "size", "source_size", "target", "each_", "offset_", "at_", "first_", *more)
    )
    words = [F.sum(F.col("size") * taken(F.lit(k))).alias(f"taken_{k}_") for k in range(TRIALS)]
    sums = placed.groupBy("first_", "target").agg(*words)
    off = [F.struct(F.abs(F.col(f"taken_{k}_") - F.col("target")).alias("off"), F.lit(k).alias("trial_")) for k in range(TRIALS)]
    trials = sized(cut(sums.select("first_", F.array_min(F.array(*off))["trial_"].alias("trial_"))))
    copies = placed.join(trials, "first_").withColumn("copies", taken(F.col("trial_")).cast("long"))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", *more)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0, 1, … times). Words are counted once; a row is known by two
    hashes of all its columns. Rows that are equal in all of them share their copies: what doesn't divide evenly comes from one of them."""
    own = docs.columns
    a, b, a_of, b_of, of, n, k = unused([*own, "size", "source_size", "target", "copies"], "a", "b", "a_of", "b_of", "of", "n", "k")
    known = docs.withColumns({a: F.xxhash64(*own), b: F.xxhash64(F.lit(1), *own)})
    counts = mix(known, more=(a, b), **how).groupBy(F.col(a).alias(a_of), F.col(b).alias(b_of))
    counts = cut(counts.agg(F.sum("copies").alias(of), F.count(F.lit(1)).alias(n)).filter(F.col(of) > 0))
    same = (F.col(a) == F.col(a_of)) & (F.col(b) == F.col(b_of))
    each = F.floor(F.col(of) / F.col(n)).cast("int")
    evenly = known.join(sized(counts), same).filter(each > 0)
    evenly = evenly.select(*own, F.explode(F.sequence(F.lit(1), each)).alias(k)).select(*own)
    rest = cut(counts.select(a_of, b_of, (F.col(of) % F.col(n)).cast("int").alias(n)).filter(F.col(n) > 0))
    if rest.isEmpty():
        return evenly
    # Rows that repeat: one of each, its copies in runs that are spread over all tasks.
    one = known.join(sized(rest), same).dropDuplicates([a, b])
    runs = one.withColumn(k, F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(RUN)))).repartition(partitions(docs.sparkSession))
    until = F.least(F.col(k) + RUN, F.col(n)) - 1
    return evenly.union(runs.select(*own, F.explode(F.sequence(F.col(k), until)).alias(k)).select(*own))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The running sum of expected copies is position x copies: all documents of a source expect the same.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, (2.0 * source_size)::DOUBLE AS cap FROM s),
b AS (SELECT *, cap / weight AS bears FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM b
      WINDOW o AS (ORDER BY bears, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT bears, place, ((SELECT (1.5 * sum(size))::DOUBLE FROM d) - cap_before) / ((SELECT sum(weight) FROM w) - weight_before) AS level FROM c),
v AS (SELECT arg_min(level, (bears, place)) AS level FROM l WHERE level <= bears),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM v) * weight) AS target,
      ('0x' || substr(md5('17:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w),
p AS (SELECT doc_id, d.source, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
      row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT p.*, k, (floor((pos + 1) * e + u + k / 16.0::DOUBLE) - floor(pos * e + u + k / 16.0::DOUBLE))::BIGINT AS copies FROM p, range(16) r(k)),
n AS (SELECT source, arg_min(k, (off, k)) AS nearest
  FROM (SELECT source, k, abs(sum(size * copies) - any_value(target)) AS off FROM k GROUP BY source, k) GROUP BY source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source AND k.k = nearest
"""
