"""Sharding along a Hilbert curve.

Three metadata dimensions are quantised to 2^BITS levels each: source and language by the share of rows before them in their order, the
length on a logarithmic scale. Rows are sorted by their place on the Hilbert curve through these cells, then by text, and cut into runs of equal
counts, one for each shard. So every shard covers a compact box of all three dimensions and readers can skip files by any of them.

The curve is walked from the highest bit down with a table of (state, octant) -> (digit, next state), made from its definition. All
of it is built-in functions; the order is numbered across ranges, so a cell with a third of all rows is spread by text and doc_id.

Defined cases: a null text has size 1 and CRC 0; null dimensions stand last in their order; equal texts of equal metadata stand together,
ties go by doc_id, and rows equal in all of these are interchangeable; an empty table gives an empty result; columns other than doc_id,
text, source and lang are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, sized, table

BITS, DIMENSIONS, SHARDS = 5, 3, 16
#: Rows of a file that ``written`` makes, at most.
FILE_ROWS = 1_000_000


def curve_table(n: int = DIMENSIONS) -> tuple[list[int], list[int]]:
    """Digits and next states of the n-dimensional curve; a state is an entry corner and a direction, entry * n + direction."""
    full = (1 << n) - 1
    right = lambda x, k: (x >> k | x << (n - k)) & full if k else x
    left = lambda x, k: right(x, (n - k) % n)
    ones = lambda x: (x ^ (x + 1)).bit_count() - 1  # trailing ones
    digits, states = [], []
    for entry in range(1 << n):
        for direction in range(n):
            for octant in range(1 << n):
                gray = right(octant ^ entry, (direction + 1) % n)
                digit = 0
                for k in range(n):
                    digit ^= gray >> k
                corner = 0 if digit == 0 else 2 * ((digit - 1) // 2)
                corner ^= corner >> 1
                turn = 0 if digit == 0 else (ones(digit - 1) if digit % 2 == 0 else ones(digit)) % n
                digits.append(digit)
                states.append((entry ^ left(corner, (direction + 1) % n)) * n + (direction + turn + 1) % n)
    return digits, states


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of the cell with these levels (0 to 2^bits - 1)."""
    n = len(levels)
    digits, states = (F.array(*[F.lit(x) for x in xs]) for xs in curve_table(n))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("state"))

    def step(done: Column, bit: Column) -> Column:
        octant = sum(((F.call_function("shiftright", level, bit) % 2) * (1 << k) for k, level in enumerate(levels)), F.lit(0))
        cell = (done["state"] * (1 << n) + octant).cast("int")
        return F.struct((done["at"] * (1 << n) + F.get(digits, cell)).alias("at"), F.get(states, cell).alias("state"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, step, lambda done: done["at"])


def by_share(rows: DataFrame, column: str, total: int, bits: int = BITS) -> DataFrame:
    """``rows`` with level_<column>: the share of rows whose value stands before, in 2^bits steps."""
    counts = cut(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_")))
    placed = ranked(counts, [F.col(column).asc_nulls_last()], ["n_"])
    levels = placed.select(F.col(column).alias("of_"), F.floor(F.col("before_n_") * (1 << bits) / max(1, total)).cast("int").alias(f"level_{column}"))
    return rows.join(sized(cut(levels)), F.col(column).eqNullSafe(F.col("of_"))).drop("of_")


def ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, source, lang, n_chars, curve and rank (from 0) of every row, and the number of rows."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    rows = cut(docs.select("doc_id", size, F.crc32(text).alias("text_crc32"), "source", "lang", F.length(text).alias("n_chars")))
    total = rows.count()
    rows = by_share(by_share(rows, "source", total), "lang", total)
    scale = F.least(F.floor(F.log2(F.col("n_chars") + F.lit(1.0)) * (1 << BITS) / 24).cast("int"), F.lit((1 << BITS) - 1))
    placed = rows.withColumn("curve", curve_index([F.col("level_source"), F.col("level_lang"), scale]))
    placed = placed.drop("level_source", "level_lang")
    return ranked(placed, [F.col("curve"), F.col("text_crc32"), F.col("size"), F.col("doc_id")]), total


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The ordered rows with shard and slot (their place in it): runs whose counts differ by one at most."""
    rows, total = ordered(docs)
    whole = lambda a, b: F.expr(f"({a}) div {b}")
    placed = rows.withColumn("shard", whole(f"rank * {shards}", max(1, total)).cast("int"))
    return placed.withColumn("slot", F.col("rank") - whole(f"shard * {total}L + {shards - 1}", shards))


def written(docs: DataFrame, path: str, shards: int = SHARDS, file_rows: int = FILE_ROWS) -> None:
    """The metadata rows as a folder for each shard, in curve order, in files of at most ``file_rows`` rows, so that min/max statistics skip
    files and row groups. Rows are dealt by ranges of (shard, slot): a shard may have many tasks and a task many shards."""
    rows = sharded(docs, shards)
    dealt = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def op9_hilbert(spark, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def sql() -> str:
    """The query in DuckDB: CRC-32 byte by byte, levels by counting, the curve bit by bit with its table."""
    digits, states = curve_table()
    steps = ["c0 AS (SELECT *, 0 AS walked, 0 AS state FROM l)"]
    for k, bit in enumerate(range(BITS - 1, -1, -1)):
        octant = " + ".join(f"((l{d} >> {bit}) & 1) * {1 << d}" for d in range(DIMENSIONS))
        steps.append(f"o{k} AS (SELECT *, (state * {1 << DIMENSIONS} + {octant} + 1)::BIGINT AS cell FROM c{k})")
        walked = f"walked * {1 << DIMENSIONS} + digits[cell] AS walked, states[cell] AS state"
        steps.append(f"c{k + 1} AS (SELECT doc_id, total, size, text_crc32, l0, l1, l2, {walked} FROM o{k}, curve)")
    share = lambda c: f"""(SELECT {c}, coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM documents GROUP BY {c})"""  # noqa: E731
    return f"""
WITH RECURSIVE t(b, c, k) AS (SELECT b, b::UBIGINT, 0 FROM range(256) r(b) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc(t) AS (SELECT list(c ORDER BY b) FROM t WHERE k = 8),
curve AS (SELECT {digits} AS digits, {states} AS states),
n AS (SELECT count(*) AS total FROM documents),
l AS (SELECT doc_id, total, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::UBIGINT),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) % 256 + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  floor(s.before * {1 << BITS} / total)::INT AS l0, floor(g.before * {1 << BITS} / total)::INT AS l1,
  least(floor(ln(length(coalesce(text, '')) + 1.0::DOUBLE) / ln(2.0::DOUBLE) * {1 << BITS} / 24)::INT, {(1 << BITS) - 1}) AS l2
  FROM documents d JOIN {share("source")} s ON s.source IS NOT DISTINCT FROM d.source JOIN {share("lang")} g ON g.lang IS NOT DISTINCT FROM d.lang, crc, n),
{", ".join(steps)},
r AS (SELECT *, row_number() OVER (ORDER BY walked, text_crc32, size, doc_id NULLS FIRST) - 1 AS rank FROM c{BITS}),
p AS (SELECT *, rank * {SHARDS} // total AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, rank - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot,
  NULL::INT AS grown_shard, walked AS curve FROM p
"""


SQL = sql()
