"""Hard-negative mining with an STR-packed R-tree of integer vectors.

The tree.  Rows are packed per label by Sort-Tile-Recursive: the coordinate of
widest spread cuts a label's rows into ``S`` slabs of equal count, the second
widest cuts each slab into ``S`` tiles, with ``S`` about the square root of the
number of leaves the label needs; a tile is dealt at random into leaves of at
most about ``LEAF_ROWS`` rows (so a vector repeated in a third of all rows fills
many small leaves).  Cut points come from ``percentile_approx`` over a grid of
``GRID`` ranks, so packing is aggregation, never a sort of a label in one task.
Every node (label root, slab, tile, leaf) keeps its minimum bounding box.

The search.  For a query vector q a box [lo, hi] bounds the inner product of
any of its points from below and above, coordinate by coordinate.  A search
asks, per (anchor, key), for the first ``K`` rows by score (ties: smaller id)
within a window [low, high] and of the anchor's label or of any other.  The
best-first descent runs level by level as Spark joins: children of kept nodes
are kept where their interval meets the window and does not lie strictly below
the k-th best score guaranteed so far (by boxes wholly inside the window,
taken by their lower bounds).  Leaves are verified in (leaf, anchor chunk)
tasks with exact integer products.

Mining.  Positives: the first ``K`` other rows of the anchor's label (window
unbounded).  Negatives per positive of score p: the first ``K`` rows of other
labels with 80 p <= 100 n <= 100 p (no window where p < 0).

Edge cases: rows with a null id, null label, null vector, or a null, NaN or
infinite component take no part.  Empty vectors score 0; unequal lengths score
over the components both have.  Rows sharing the anchor's id are not its
positives.  Repeated rows stand as often as they occur; an anchor id standing
twice is searched once per row, and its results merge.  An empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.shared import saved
from patchloom.llm.vectors import integer_rows

SCALE = 256
K = 5
LEAF_ROWS = 1024
ANCHOR_ROWS = 1024
GRID = 256
#: A level's nodes are broadcast up to this many rows (counted); beyond, asks meet them over ``SALTS``
#: salts, so the asks under one parent (a label's root holds all of its anchors) are no single task.
BROADCAST_NODES = 20_000
SALTS = 32
SLACK = 1e-9

FOUND = "anchor_id long, key long, vec_id long, score long"


def _relabelled(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", label.alias("label"))
    return integer_rows(rows, SCALE, "vec_id", "embedding", "label").drop("norm")


def _coordinate(i: int):
    return F.coalesce(F.get("ints", i), F.lit(0))


def _slabs(rows: DataFrame, group: list[str], dim: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the slab along ``dim`` among ``parts`` equal-count slabs of its ``group``."""
    grid = [i / GRID for i in range(1, GRID)]
    cuts = rows.groupBy(*group).agg(F.percentile_approx(_coordinate(dim), grid, 10 * GRID).alias("cuts"))
    rows = rows.join(cuts, group)
    rank = F.size(F.filter("cuts", lambda c: c < _coordinate(dim)))
    return rows.withColumn(name, F.floor(rank * F.col("parts") / GRID).cast("bigint")).drop("cuts")


def _box(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.array(*[F.min(_coordinate(i)) for i in range(width)]).alias("lo"),
        F.array(*[F.max(_coordinate(i)) for i in range(width)]).alias("hi"),
    )


def build_tree(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(leaf rows, nodes): rows with ``leaf``; nodes (level, node, parent, label, count, lo, hi)."""
    spread = rows.agg(*[F.stddev_pop(_coordinate(i)).alias(str(i)) for i in range(width)]).first()
    dims = sorted(range(width), key=lambda i: (-(spread[i] or 0.0), i))[:2] + [0, 0]
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    parts = F.least(F.lit(GRID), F.ceil(F.sqrt(F.ceil(F.col("n") / LEAF_ROWS)))).cast("bigint").alias("parts")
    rows = rows.join(F.broadcast(sizes.select("label", parts)), "label")  # one row per label
    rows = _slabs(rows, ["label"], dims[0], "s1")
    rows = _slabs(rows, ["label", "s1"], dims[1], "s2").drop("parts")
    tiles = rows.groupBy("label", "s1", "s2").agg(F.ceil(F.count("*") / LEAF_ROWS).alias("pieces"))
    rows = rows.join(tiles, ["label", "s1", "s2"])
    rows = rows.withColumn("s3", F.floor(F.rand(29) * F.col("pieces")).cast("bigint")).drop("pieces")
    rows = saved(rows.withColumn("leaf", F.array("label", "s1", "s2", "s3")))
    nodes = []
    for level, keys in enumerate((["label"], ["label", "s1"], ["label", "s1", "s2"], ["label", "s1", "s2", "s3"])):
        boxes = _box(rows, keys, width)
        parent = F.array(*keys[:-1]) if level else F.array().cast("array<bigint>")
        nodes.append(boxes.select(F.lit(level).alias("level"), F.array(*keys).alias("node"), parent.alias("parent"),
                                  F.col("label"), "count", "lo", "hi"))
    tree = nodes[0]
    for more in nodes[1:]:
        tree = tree.unionByName(more)
    return rows.select("id", "label", "ints", "leaf"), saved(tree)


def _bounds(q: str):
    """(lowest, highest) inner product of ``q`` with the box (lo, hi)."""
    zipped = F.arrays_zip(F.col(q).alias("q"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))

    def ends(p, pick):
        a = F.coalesce(p.q, F.lit(0)) * F.coalesce(p.lo, F.lit(0))
        b = F.coalesce(p.q, F.lit(0)) * F.coalesce(p.hi, F.lit(0))
        return pick(a, b).cast("double")

    low = F.aggregate(zipped, F.lit(0.0), lambda acc, p: acc + ends(p, F.least))
    high = F.aggregate(zipped, F.lit(0.0), lambda acc, p: acc + ends(p, F.greatest))
    return low, high


def _descend(asks: DataFrame, nodes: DataFrame, level: int, chunks: int) -> DataFrame:
    """Asks (anchor_id, key, ...) with ``node`` at ``level`` after one best-first step from ``level`` - 1."""
    children = nodes.where(F.col("level") == level).drop("level")
    if level == 0:
        # the roots, one per label, go to every chunk of anchors: a stated query set against all rows
        children = children.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
        joined = asks.join(children.drop("parent"), "chunk")
    elif children.count() <= BROADCAST_NODES:
        joined = asks.join(F.broadcast(children.withColumnRenamed("node", "child")), asks["node"] == children["parent"])
        joined = joined.drop("node", "parent").withColumnRenamed("child", "node")
    else:
        salted = children.withColumnRenamed("node", "child").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        spread = asks.withColumn("salt", F.pmod(F.col("anchor_row"), F.lit(SALTS)))
        joined = spread.join(salted, (spread["node"] == salted["parent"]) & (spread["salt"] == salted["salt"]))
        joined = joined.drop("node", "parent", "salt").withColumnRenamed("child", "node")
    low, high = _bounds("ints")
    joined = joined.withColumn("b_low", low).withColumn("b_high", high)
    fits = F.when(F.col("same"), F.col("label") == F.col("a_label")).otherwise(F.col("label") != F.col("a_label"))
    meets = (F.col("b_high") * (1 + SLACK) + 1 >= F.col("low")) & (F.col("b_low") - 1 <= F.col("high") * (1 + SLACK))
    joined = joined.where(fits & meets)
    inside = (F.col("b_low") >= F.col("low")) & (F.col("b_high") <= F.col("high"))
    one = ["anchor_row", "key"]
    order = Window.partitionBy(*one).orderBy(F.desc_nulls_last(F.when(inside, F.col("b_low"))), "node")
    held = F.sum(F.when(inside, F.col("count")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = joined.withColumn("held", held)
    guaranteed = F.max(F.when(F.col("held") >= F.col("need"), F.col("b_low"))).over(Window.partitionBy(*one))
    joined = joined.withColumn("theta", F.greatest("theta", F.coalesce(guaranteed, F.lit(-math.inf))))
    joined = joined.where(F.col("b_high") * (1 + SLACK) + 1 >= F.col("theta"))
    return joined.drop("b_low", "b_high", "held", "label", "count", "lo", "hi")


def _verify(k: int, width: int):
    def run(asks: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
        out = {"anchor_id": [], "key": [], "vec_id": [], "score": []}
        if len(asks) and len(leaf):
            ids = leaf["id"].to_numpy(np.int64)
            labels = leaf["label"].to_numpy(np.int64)
            rows = np.zeros((len(leaf), width), np.int64)
            for i, v in enumerate(leaf["ints"]):
                rows[i, : len(v)] = v
            for a in asks.itertuples(index=False):
                q = np.zeros(width, np.int64)
                q[: len(a.ints)] = a.ints
                scores = rows @ q
                keep = (labels == a.a_label) if a.same else (labels != a.a_label)
                keep &= ids != a.anchor_id
                if a.key >= 0:  # a negative's window, exactly: 80 p <= 100 n <= 100 p
                    keep &= (80 * a.p_score <= 100 * scores) & (100 * scores <= 100 * a.p_score)
                keep &= scores >= a.theta if math.isfinite(a.theta) else True
                at = np.flatnonzero(keep)
                best = at[np.lexsort((ids[at], -scores[at]))[:k]]
                out["anchor_id"].append(np.full(len(best), a.anchor_id, np.int64))
                out["key"].append(np.full(len(best), a.key, np.int64))
                out["vec_id"].append(ids[best])
                out["score"].append(scores[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()})

    return run


def _search(asks: DataFrame, leaves: DataFrame, nodes: DataFrame, k: int, width: int, chunks: int) -> DataFrame:
    """The first ``k`` rows per ask (anchor_row, key): ``asks`` holds anchor_id, ints, a_label, same, low, high, need."""
    asks = asks.withColumn("theta", F.lit(-math.inf))
    for level in range(4):
        asks = saved(_descend(asks, nodes, level, chunks))
    needed = asks.select(F.col("node").alias("n_leaf"), F.col("chunk").alias("n_chunk")).distinct()
    needed = needed.select(F.col("n_leaf").alias("leaf"), F.col("n_chunk").alias("chunk"))
    sent = leaves.join(needed, "leaf")
    left = asks.withColumnRenamed("node", "leaf").select("leaf", "chunk", "anchor_id", "key", "ints", "a_label",
                                                       "same", "theta", "p_score")
    found = left.groupBy("leaf", "chunk").cogroup(sent.groupBy("leaf", "chunk")).applyInPandas(_verify(k, width), FOUND)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings``."""
    rows = _relabelled(embeddings)
    width = rows.select(F.max(F.size("ints"))).first()[0]
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return embeddings.sparkSession.createDataFrame([], empty)
    leaves, nodes = build_tree(rows, max(width, 1))
    anchors = rows.where(F.col("id") % every == 0)
    same_id = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.count("*").alias("copies"))
    anchors = anchors.dropDuplicates(["id", "label", "ints"]).join(same_id, "id")
    anchors = anchors.withColumn("anchor_row", F.monotonically_increasing_id())
    chunks = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks))
    anchors = saved(anchors.select(F.col("id").alias("anchor_id"), "anchor_row", "ints", F.col("label").alias("a_label"),
                                   chunk.alias("chunk"), "copies"))
    positive_asks = anchors.select("anchor_id", "anchor_row", "ints", "a_label", "chunk", F.lit(-1).cast("bigint").alias("key"),
                                   F.lit(True).alias("same"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"),
                                   (F.lit(k) + F.col("copies")).alias("need"), F.lit(None).cast("bigint").alias("p_score"))
    positives = saved(_search(positive_asks, leaves, nodes, k, width, chunks))
    pos = positives.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("p_score")).distinct()
    negative_asks = anchors.join(pos, "anchor_id").where(F.col("p_score") >= 0).select(
        "anchor_id", "anchor_row", "ints", "a_label", "chunk", "key", F.lit(False).alias("same"),
        (F.col("p_score") * 0.8).alias("low"), F.col("p_score").cast("double").alias("high"), F.lit(k).alias("need"),
        "p_score")
    negatives = _search(negative_asks, leaves, nodes, k, width, chunks)
    return negatives.join(pos, ["anchor_id", "key"]).select(
        "anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
