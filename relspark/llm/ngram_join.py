"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

1. Each text becomes the set of its word 5-grams, a key of that set, and ``bands`` hashes of ``rows`` MinHash values each.
2. Equal sets are one node (with the number of its documents), so copies are never paired with each other.
3. Nodes that agree in a band meet by that band's hash, in a bucket. Each node takes the least node that it meets as its root, and then
   ``JUMPS`` times its root's root, so that nodes of one group of near copies mostly have one root.
4. The nodes of a root are cut into blocks of bounded volume. Two blocks that meet in some bucket are one unit of work, and so is each
   block by itself: all its pairs of nodes are verified on their full sets. Blocks without a common bucket are never compared. A unit
   returns the number of links per node and the edges of a spanning forest, never the pairs.
5. The components of the verified edges are the classes.

A bucket of m different texts takes (m / block)^2 / 2 units, without a cap on partners; blocks whose sizes exclude the similarity are
skipped. Every link between nodes that share a bucket is found and counted exactly; a pair of similarity s shares one with a probability
of 1 - (1 - s^rows)^bands.

Defined cases: null, empty and blank texts have no n-grams, link with nothing and are a class each; a text of 1 to 4 words has one n-gram,
of all its words; equal rows are copies; a null or repeated doc_id is reported, and takes part like any other (a row is known by doc_id and a
hash of its text); an empty table gives an empty result; columns other than doc_id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, in_small_batches, partitions, ranked, sized, table, unused
from .shingles import mixed, set_key, shingles

WORDS, SIMILARITY, RECALL, JUMPS = 5, 0.8, 0.999, 2
#: n-grams (and as many again as NODE for each node) in a block.
BLOCK, NODE = 100_000, 400


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which ``hashes`` values reach ``recall`` at ``similarity``."""
    for rows in range(16, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("more hashes are needed for this recall")


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of the MinHash signature of a set that isn't empty."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, mixed_high(grams[at : at + 2048, None] * factors).min(axis=0))
    place = np.arange(bands * rows, dtype=np.uint64)
    weighed = mixed(least + place) * (place % np.uint64(rows) * np.uint64(2) + np.uint64(1))
    sums = weighed.reshape(bands, rows).sum(axis=1, dtype=np.uint64)
    return mixed(sums + np.arange(bands, dtype=np.uint64)).view(np.int64)


def mixed_high(x: np.ndarray) -> np.ndarray:
    """A cheap order of products: their high bits depend on all bits of the hash."""
    return x ^ (x >> np.uint64(32))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the first two say which row it is, but for rows that are equal in them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            found = {
                "doc_id": pdf["doc_id"].astype("Int64"),
                "text_hash": pdf["text_hash"],
                "node": [set_key(s) if len(s) else None for s in sets],
                "size": [len(s) for s in sets],
                "bands": [band_hashes(s, bands, rows) if len(s) else None for s in sets],
            }
            yield pd.DataFrame(found)

    return in_small_batches(keyed(docs)).mapInPandas(signed, "doc_id long, text_hash long, node binary, size int, bands array<long>")


def distinct_nodes(signed: DataFrame) -> DataFrame:
    """node, least_id, copies, size, bands, and one of its rows: of_id, of_hash and how many rows are equal to it in both."""
    rows = signed.filter("node IS NOT NULL").groupBy("node", "doc_id", "text_hash")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    one = F.min(F.struct("doc_id", "text_hash", "n")).alias("one")
    known = [F.first("size").alias("size"), F.first("bands").alias("bands")]
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.sum("n").alias("copies"), *known, one)
    row = [F.col("one.doc_id").alias("of_id"), F.col("one.text_hash").alias("of_hash"), F.col("one.n").alias("of_n")]
    return nodes.select("node", "least_id", "copies", "size", "bands", *row)


def meetings(nodes: DataFrame) -> DataFrame:
    """(bucket, node, least): the buckets of several nodes with their nodes."""
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    least = exploded.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    return exploded.join(least.filter("n > 1").drop("n"), "bucket")


def near_roots(met: DataFrame) -> DataFrame:
    """(node, root) of all nodes that meet another."""
    roots = cut(met.groupBy("node").agg(F.min("least").alias("root")))
    for _ in range(JUMPS):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = roots.join(up, "root").select("node", F.col("up").alias("root"))
    return roots


def blocks_of(roots: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """The nodes that meet another with the number of their block: nodes of one root, in order of size."""
    groups = roots.join(nodes.drop("bands"), "node").withColumn("volume", (F.col("size") + NODE).cast("long"))
    placed = cut(ranked(groups, [F.col("root"), F.col("size"), F.col("node")], ["volume"], "rank_"))
    first = sized(cut(placed.groupBy("root").agg(F.min("before_volume").alias("first"))))
    cuts = placed.join(first, "root").withColumn("part", F.floor((F.col("before_volume") - F.col("first")) / block))
    cuts = cut(cuts.drop("first", "before_volume", "volume"))
    number = sized(cut(cuts.groupBy("root", "part").agg(F.min("rank_").alias("block"))))
    return cuts.join(number, ["root", "part"]).drop("root", "part", "rank_")


def units_of(met: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks that meet in a bucket, and each block of several nodes by itself."""
    blocks = cut(placed.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("n")))
    there = cut(met.join(placed.select("node", "block"), "node").select("bucket", "block").distinct())
    mixed_ = there.groupBy("bucket").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a != b").select("bucket")
    there = cut(there.join(mixed_, "bucket", "left_semi"))
    pairs = there.select("bucket", F.col("block").alias("i")).join(there.select("bucket", F.col("block").alias("j")), "bucket")
    pairs = pairs.filter("i < j").select("i", "j").distinct()
    left, right = (blocks.select(F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}")) for k in "ij")
    sized_pairs = pairs.join(left, "i").join(right, "j")
    alike = (F.col("high_i") >= similarity * F.col("low_j")) & (F.col("high_j") >= similarity * F.col("low_i"))
    own = blocks.filter("n > 1").select(F.col("block").alias("i"), F.col("block").alias("j"))
    return sized_pairs.filter(alike).select("i", "j").union(own)


def verified(similarity: float):
    """The unit of work: the rows of one pair of blocks -> links per node, and edges that connect the linked ones."""

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "node"], ignore_index=True)
        own = key[0] == key[1]
        size, copies = pdf["size"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        split = len(pdf) if own else int((pdf["block"] == key[0]).sum())
        sets = [np.frombuffer(b, np.uint64) for b in pdf["grams"]]
        rows = np.repeat(np.arange(len(sets)), size)
        grams, column = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(column, minlength=len(grams)) > 1
        kept = often[column]
        rows, column = rows[kept], (np.cumsum(often) - 1)[column[kept]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        left, right = (slice(0, len(pdf)), slice(0, len(pdf))) if own else (slice(0, split), slice(split, len(pdf)))
        common = np.zeros((left.stop, right.stop - right.start), np.float32)
        for at in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(pdf), 4096), np.float32)
            part[rows[a:b], column[a:b] - at] = 1
            common += part[left] @ part[right].T
        linked = common >= np.float32(similarity) * (size[left, None] + size[None, right] - common) - 1e-3
        i, j = np.nonzero(linked)
        both = common[i, j].astype(np.int64)
        sure = both >= similarity * (size[i] + size[j + right.start] - both) - 1e-9
        i, j = i[sure], j[sure] + right.start
        if own:
            i, j = i[i != j], j[i != j]
        links = np.bincount(i, copies[j], len(pdf)) if own else np.bincount(np.r_[i, j], np.r_[copies[j], copies[i]], len(pdf))
        root = np.arange(len(pdf))
        for a, b in zip(i, j, strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        node, to = pdf["node"].to_numpy(), [int(x) for x in root]
        for k in range(len(to)):
            to[k] = to[to[k]]
        out = pd.DataFrame({"node": node, "links": links.astype(np.int64), "other": [node[k] for k in to]})
        return out[out["links"] > 0]

    return verify


def links(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every row of ``docs``: the least doc_id of its class, the least doc_id with the same set, and the
    number of other rows of at least that similarity."""
    return linked(docs, words, similarity, recall, block).select("doc_id", "class_id", "copy_id", "n_links")


def linked(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``links`` with text_hash, node (the key of the row's n-gram set, null without words) and class (the least node of its class)."""
    bands, rows = banding(similarity, recall)
    signed = cut(signatures(docs, words, bands, rows))
    nodes = cut(distinct_nodes(signed))
    met = cut(meetings(nodes))
    placed = cut(blocks_of(near_roots(met), nodes, block))
    units = cut(units_of(met, placed, similarity))
    sides = sized(units.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    work = cut(gram_sets(docs, placed, words)).join(sides, "block")
    # Dealt by range of units: even shares, as a hash would put several large units into one task.
    dealt = work.repartitionByRange(partitions(docs.sparkSession), "i", "j")
    found = cut(dealt.groupBy("i", "j").applyInPandas(verified(similarity), "node binary, links long, other binary"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("root", "class")
    classed = nodes.select("node", "least_id", "copies").join(counts, "node", "left").join(roots, "node", "left")
    classed = cut(classed.withColumn("class", F.coalesce("class", "node")))
    least = classed.groupBy("class").agg(F.min("least_id").alias("class_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    classed = classed.join(least, "class")
    classed = classed.select(F.col("node").alias("node_"), "class", "class_id", F.col("least_id").alias("copy_id"), n_links.alias("n_links"))
    result = signed.select("doc_id", "text_hash", "node").join(classed, F.col("node") == F.col("node_"), "left")
    ids = [F.coalesce(c, "doc_id").alias(c) for c in ("class_id", "copy_id")]
    return result.select("doc_id", "text_hash", "node", "class", *ids, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def texts_of(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with the text of one row of each node."""
    rows = keyed(docs)
    of = sized(placed)
    same = rows.doc_id.eqNullSafe(F.col("of_id")) & (rows.text_hash == F.col("of_hash"))
    found = rows.join(of, same).select("block", "node", "copies", "size", "of_n", "text")
    if placed.filter("of_n > 1").isEmpty():
        return found.drop("of_n")
    once = found.filter("of_n > 1").dropDuplicates(["node"])  # rows that are equal in doc_id and text
    return found.filter("of_n = 1").union(once).drop("of_n")


def gram_sets(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """``placed`` with the n-gram set of each node, made anew from a text of it."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            same = [set_key(s) == n for s, n in zip(sets, pdf["node"], strict=True)]
            yield pdf.assign(grams=[s.tobytes() for s in sets]).drop(columns="text")[same]

    return in_small_batches(texts_of(docs, placed)).mapInPandas(made, "block long, node binary, copies long, size int, grams binary")


def one_of_each(docs: DataFrame, words: int = WORDS, **how) -> DataFrame:
    """``docs`` without near duplicates: of each class the document with the least doc_id (of different texts with that id, the one with the
    least node) stays, and one of the rows that repeat it. Rows without words or doc_id stay. A doc_id may stand for several texts. Columns
    may be called anything."""
    own = docs.columns
    of_id, of_hash, hash_ = unused(own, "of_id", "of_hash", "hash")
    # Cut before they are grouped, so that Spark can split a node of many copies in the join that gave the rows their class.
    rows = cut(linked(docs, words, **how).filter("doc_id IS NOT NULL AND node IS NOT NULL"))
    rows = cut(rows.groupBy("doc_id", "text_hash", "node", "class").agg(F.count(F.lit(1)).alias("n")))
    one = F.struct("doc_id", "node", "text_hash")
    least = rows.groupBy("class").agg(F.min(one).alias("least"), F.count(F.lit(1)).alias("texts"))
    several = cut(least.filter("texts > 1").select("class", "least"))
    goes = rows.join(several, "class").filter(one != F.col("least"))
    names = [F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)]
    goes = sized(cut(goes.select(*names)))
    known = docs.withColumn(hash_, F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(hash_) == F.col(of_hash))
    stay = known.join(goes, same, "left_anti")
    repeated = cut(rows.filter("n > 1").select(*names))
    if not repeated.isEmpty():
        again = sized(repeated)
        once = stay.join(again, same, "left_semi").dropDuplicates(["doc_id", hash_])
        stay = stay.join(again, same, "left_anti").union(once)
    return stay.select(*own)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))
