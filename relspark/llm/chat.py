"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered once, as the prompt;
the turns behind it are the two completions. The result has a row for each rendered turn, so a conversation of any length stays spread: its
part (prompt, chosen or rejected), its place, the rendered text, and the span of it (in code points) that a loss covers: the words and the end
mark of assistant turns in a completion. Everything else is masked: loss_from and loss_to are null.

Texts are read twice but move once. Turns are numbered, compared and parted as narrow rows (pair, turn, role and half a SHA-256 of the text):
one global sort gives the places, the prefix ends at the least place where the sides differ, both by joins and aggregations with
map-side combine on (pair, place). The texts then join the rows that are to be rendered. Turns that are equal in everything, which
that join can't tell apart, are reduced to one text first. Built-in functions only.

Defined cases: a null text or role is rendered as the empty one and equals only another null; a pair of equal conversations is all prompt; one
without a common turn has an empty prompt; a side may be missing; turns that repeat a number stand by role, then text, those without a
number behind all others; a null id is a conversation like any other; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, table

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
#: What tells turns apart. Nulls are equal to each other.
KEY = ("pair_id", "turn", "role", "text_hash")


def hashed(turns: DataFrame) -> DataFrame:
    """pair_id, turn, role, text_hash (128 bits), text. The hash of a null text is the empty one."""
    text_hash = F.coalesce(F.substring(F.unhex(F.sha2("text", 256)), 1, 16), F.lit(b"")).alias("text_hash")
    return turns.select("pair_id", "turn", "role", text_hash, "text")


def meet(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """The join of both sides on these columns, in which null equals null."""
    right = right.select(*[F.col(c).alias(f"{c}_of") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in keys]
    joined = left.join(right, reduce(lambda x, y: x & y, same), how)
    return joined.drop(*[f"{c}_of" for c in keys])


def in_order_of_text(turns: DataFrame, narrow: DataFrame) -> DataFrame:
    """``narrow`` with tie: 0, or the order of the texts where several stand at one turn with one role."""
    at = [c for c in KEY if c != "text_hash"]
    tied = narrow.groupBy(*at).agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a != b").select(*at)
    tied = cut(tied)
    if tied.isEmpty():
        return narrow.withColumn("tie", F.lit(0).cast("long"))
    rows = hashed(turns)
    texts = meet(rows, tied, *at, how="left_semi").dropDuplicates(KEY)
    order = [F.col("pair_id"), F.col("turn"), F.col("role"), F.left("text", F.lit(64)), F.col("text")]
    ties = cut(ranked(texts, order, rank="tie", deal=4).drop("text"))
    return meet(narrow, ties, *KEY, how="left").withColumn("tie", F.coalesce("tie", F.lit(0)))


def placed(turns: DataFrame) -> DataFrame:
    """pair_id, turn, role, text_hash, place (0, 1, … in each pair) of turns (pair_id, turn, role, text)."""
    narrow = in_order_of_text(turns, cut(hashed(turns).drop("text")))
    # Equal turns are interchangeable; a number of their own spreads them.
    narrow = narrow.withColumn("own", F.monotonically_increasing_id())
    order = [F.col("pair_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("tie"), F.col("own")]
    rows = cut(ranked(narrow, order))
    first = rows.groupBy("pair_id").agg(F.min("rank").alias("first"))
    return cut(meet(rows, first, "pair_id").select(*KEY, (F.col("rank") - F.col("first")).alias("place")))


def parted(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides (with pair_id, place, role, text_hash) with their part; those of the prompt are in the first one only."""
    what = ("pair_id", "place", "role", "text_hash")
    there = meet(a, b.select(*what), *what, how="left_anti").select("pair_id", "place")
    here = meet(b, a.select(*what), *what, how="left_anti").select("pair_id", "place")
    splits = cut(there.union(here).groupBy("pair_id").agg(F.min("place").alias("split")))

    def with_part(side: DataFrame, part: str) -> DataFrame:
        prompt = F.col("split").isNull() | (F.col("place") < F.col("split"))
        joined = meet(side, splits, "pair_id", how="left")
        return joined.withColumn("part", F.when(prompt, "prompt").otherwise(part)).drop("split")

    return with_part(a, "chosen"), with_part(b, "rejected").filter("part != 'prompt'")


def with_texts(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` (``KEY`` of a turn in ``turns``, and more) with its text."""
    texts, rows = hashed(turns), cut(rows)
    copies = cut(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if copies.isEmpty():
        return meet(rows, texts, *KEY)
    once = meet(texts, copies, *KEY, how="left_semi").dropDuplicates(KEY)
    alone, among = (meet(rows, copies, *KEY, how=how) for how in ("left_anti", "left_semi"))
    return meet(alone, texts, *KEY).union(meet(among, once, *KEY))


def rendered(rows: DataFrame) -> DataFrame:
    """The rendered turns of rows (pair, part, place, role, text)."""
    head = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit(MIDDLE))
    whole = F.concat(head, F.coalesce("text", F.lit("")), F.lit(END))
    learnt = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    spans = [F.when(learnt, F.length(head)).cast("long").alias("loss_from"), F.when(learnt, F.length(whole) - 1).cast("long").alias("loss_to")]
    return rows.select(F.col("pair").alias("pair_id"), "part", "place", "role", whole.alias("rendered"), *spans)


def preference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rendered turns of all pairs; each side has a row (pair_id, turn, role, text) for each turn."""
    a, b = parted(placed(chosen), placed(rejected))
    sides = [with_texts(rows.withColumn("pair", F.col("pair_id")), turns) for rows, turns in ((a, chosen), (b, rejected))]
    return rendered(sides[0].unionByName(sides[1]))


def against_next_reply(turns: DataFrame) -> DataFrame:
    """``preference`` of each conversation as chosen, against itself up to its last assistant turn and there the last assistant turn of the next
    conversation that has one (in order of id; after the last: the first). Without an assistant turn both sides are the conversation."""
    a = placed(turns)
    key = F.struct(*KEY)
    last = a.filter("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("place", key.alias("key"))).alias("last"))
    last = cut(ranked(last, [F.col("pair_id").asc_nulls_last()]))
    n = last.count()
    before = (F.col("rank") - 1 + F.when(F.col("rank") == 0, n).otherwise(0)).alias("rank")
    reply = last.select(before, F.col("last.key").alias("reply"))
    replies = cut(last.join(reply, "rank").select(F.col("pair_id").alias("of"), F.col("last.place").alias("until"), "reply"))
    cuts = replies.select(F.col("of").alias("pair_id"), "until")
    kept = meet(a, cuts, "pair_id", how="left").filter("until IS NULL OR place < until")
    own = kept.select(F.col("pair_id").alias("pair"), *[F.col(c).alias(f"of_{c}") for c in KEY], "place", "role", "text_hash")
    other = [F.col(f"reply.{c}").alias(f"of_{c}") for c in KEY]
    text_hash = F.col("reply.text_hash").alias("text_hash")
    new = replies.select(F.col("of").alias("pair"), *other, F.col("until").alias("place"), F.lit("assistant").alias("role"), text_hash)
    b = cut(own.union(new).withColumnRenamed("pair", "pair_id"))
    chosen, rejected = parted(a, b)
    chosen = chosen.select(*KEY, F.col("pair_id").alias("pair"), "place", "part")
    rejected = rejected.select(*[F.col(f"of_{c}").alias(c) for c in KEY], F.col("pair_id").alias("pair"), "place", "part")
    return rendered(with_texts(chosen.union(rejected), turns))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """Each conversation as chosen, against itself with the last reply of the next one."""
    turns = table(spark, sf_dir, "conversations")
    return against_next_reply(turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))


SQL = r"""
WITH a AS (SELECT conv_id AS pair_id, role, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
s AS (SELECT pair_id, max({'place': place, 'text': text}) AS last FROM a WHERE role = 'assistant' GROUP BY pair_id),
n AS (SELECT pair_id, last.place AS until, coalesce(lead(last.text) OVER w, first_value(last.text) OVER w) AS reply FROM s
  WINDOW w AS (ORDER BY pair_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT a.pair_id, role, text, place FROM a LEFT JOIN n ON n.pair_id IS NOT DISTINCT FROM a.pair_id WHERE until IS NULL OR place < until
  UNION ALL SELECT pair_id, 'assistant', reply, until FROM n),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.place, b.place)) AS split
  FROM a FULL JOIN b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.place = b.place
  WHERE a.place IS NULL OR b.place IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
t AS (SELECT a.*, CASE WHEN split IS NULL OR place < split THEN 'prompt' ELSE 'chosen' END AS part
  FROM a LEFT JOIN d ON d.pair_id IS NOT DISTINCT FROM a.pair_id
  UNION ALL SELECT b.pair_id, role, text, place, 'rejected' FROM b JOIN d ON d.pair_id IS NOT DISTINCT FROM b.pair_id WHERE place >= split)
SELECT pair_id, part, place, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  CASE WHEN part != 'prompt' AND role = 'assistant' THEN length('<|' || role || '|>') + 1 END AS loss_from,
  CASE WHEN part != 'prompt' AND role = 'assistant' THEN length('<|' || role || '|>') + 1 + length(coalesce(text, '')) + 7 END AS loss_to FROM t
"""
