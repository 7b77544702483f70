"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are grouped by length: a bucket holds vectors whose norms lie within a
factor ``RATIO`` of each other, and a bucket is dealt at random into blocks of
about ``BLOCK_ROWS`` rows, so no block grows with the data, even where one vector
stands in a third of all rows.  Queries travel in chunks of about ``QUERY_ROWS``.

1. A pilot pass scores every query against the ``PILOT_BLOCKS`` blocks of
   greatest norm; its k-th best score ``theta`` bounds the final k-th from below.
2. A block whose largest norm times the query's norm, or whose bounding box
   (per-coordinate least and greatest value), cannot reach ``theta`` is never
   sent to the query.  These bounds are Spark expressions over a table of one
   row per block.
3. Inside a task (one block, one chunk of queries) each query first verifies
   its ``k`` longest candidates, raising ``theta``; then the local cosine
   threshold ``t = theta / (|q| * largest norm)`` chooses the pruning: LENGTH
   keeps candidates with ``|x| >= theta / |q|``, COORD keeps those whose unit
   vector's focus coordinate (the query's largest) lies in the interval that a
   cosine of at least ``t`` allows.  The smaller set is verified with exact
   integer products.
4. The k best of a query over all blocks win; ties go to the smaller id.

Edge cases: rows with a null id, a null vector, or a null, NaN or infinite
component take no part.  An empty vector is usable and scores 0 with all; a
zero vector too.  Vectors of unequal length score over the components both
have.  Rows sharing an id with the query are not its candidates; repeated rows
are candidates as often as they stand; a query id standing twice keeps the k
best of both rows together.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.shared import saved
from patchloom.llm.vectors import integer_rows

SCALE = 1024
K = 10
RATIO = 1.25
BLOCK_ROWS = 2048
QUERY_ROWS = 1024
PILOT_BLOCKS = 4
#: The table of blocks is broadcast up to this many rows (counted); beyond, queries meet blocks by
#: (bucket, part) keys with about ``BLOCKS_PER_KEY`` blocks under a key, so no bucket is one task.
BROADCAST_BLOCKS = 20_000
BLOCKS_PER_KEY = 64
#: Relative slack that keeps floating-point bounds on the safe side; products are verified exactly.
SLACK = 1e-9

HITS = "query_id long, vec_id long, score long"


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, values in enumerate(vectors):
        out[row, : len(values)] = values
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by score, then smaller id."""
    order = np.lexsort((ids, -scores))
    return order[:k]


class _Block:
    """A block's candidates, longest first, with unit vectors sorted per coordinate on demand."""

    def __init__(self, cands: pd.DataFrame, width: int):
        order = np.argsort(-cands["norm"].to_numpy(), kind="stable")
        self.ids = cands["id"].to_numpy(np.int64)[order]
        self.norms = cands["norm"].to_numpy(np.float64)[order]
        self.ints = _matrix(cands["ints"].iloc[order], width)
        safe = np.where(self.norms > 0, self.norms, 1.0)
        self.units = self.ints / safe[:, None]
        self.largest = float(self.norms[0]) if len(self.norms) else 0.0
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.units[:, f], kind="stable")
            self.sorted[f] = (self.units[order, f], order)
        return self.sorted[f]

    def search(self, qid: int, q: np.ndarray, theta: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of candidates that can stand among the ``k`` best, all verified."""
        n, head = len(self.ids), min(k, len(self.ids))
        qn = math.sqrt(float(np.dot(q.astype(np.float64), q.astype(np.float64))))
        seed = np.arange(head)
        seed = seed[self.ids[seed] != qid]
        seen = self.ints[seed] @ q
        if len(seen) >= k:
            theta = max(theta, float(np.sort(seen)[-k]))
        rest = np.arange(head, n)
        if theta > 0 and qn > 0:
            t = theta / (qn * self.largest) if self.largest > 0 else math.inf
            if t > 1 + SLACK:
                rest = rest[:0]
            else:
                longest = int(np.searchsorted(-self.norms, -(theta / qn) * (1 - SLACK), side="right"))
                by_length = rest[rest < longest]
                t = min(t, 1.0) * (1 - SLACK)
                unit_q = q / qn
                f = int(np.argmax(np.abs(unit_q)))
                # angles: x's angle to axis f differs from q's by at most arccos(t)
                qf = float(unit_q[f])
                spread = math.sqrt(max(0.0, (1 - t * t) * (1 - qf * qf)))
                low = -1.0 if -qf >= t else t * qf - spread
                high = 1.0 if qf >= t else t * qf + spread
                values, order = self.coordinate(f)
                lo = np.searchsorted(values, low - SLACK, side="left")
                hi = np.searchsorted(values, high + SLACK, side="right")
                if hi - lo < len(by_length):
                    inside = np.sort(order[lo:hi])
                    rest = inside[(inside >= head) & (inside < longest)]
                else:
                    rest = by_length
        rest = rest[self.ids[rest] != qid]
        scores = np.concatenate((seen, self.ints[rest] @ q))
        positions = np.concatenate((seed, rest))
        keep = scores >= theta if math.isfinite(theta) else np.ones(len(scores), bool)
        positions, scores = positions[keep], scores[keep]
        best = _best(scores, self.ids[positions], k)
        return positions[best], scores[best]


def _searcher(width: int, k: int):
    def search(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(cands):
            empty = np.empty(0, np.int64)
            return pd.DataFrame({"query_id": empty, "vec_id": empty, "score": empty})
        block = _Block(cands, width)
        qs = _matrix(queries["ints"], width)
        thetas = queries["theta"].to_numpy(np.float64, na_value=-np.inf)
        out_q, out_v, out_s = [], [], []
        for row, qid in enumerate(queries["id"].to_numpy(np.int64)):
            positions, scores = block.search(int(qid), qs[row], float(thetas[row]), k)
            out_q.append(np.full(len(positions), qid, np.int64))
            out_v.append(block.ids[positions])
            out_s.append(scores)
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                             "score": np.concatenate(out_s)})

    return search


def _box_bound(q: str, lo: str, hi: str):
    """Largest inner product of ``q`` with any point of the box [lo, hi]; missing components count as 0."""
    pairs = F.arrays_zip(F.col(q).alias("q"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    best = lambda p: F.greatest(F.coalesce(p.q, F.lit(0)) * F.coalesce(p.lo, F.lit(0)),
                                F.coalesce(p.q, F.lit(0)) * F.coalesce(p.hi, F.lit(0))).cast("double")
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + best(p))


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows with ``bucket`` (by norm) and ``block`` (bucket and a random part of it)."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / math.log(RATIO))).otherwise(F.lit(-(2**20)))
    rows = rows.withColumn("bucket", bucket.cast("bigint"))
    sizes = rows.groupBy("bucket").count()
    # one row per bucket: norms of BIGINT vectors span a bounded number of factors RATIO
    parts = F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK_ROWS)).alias("parts")
    rows = rows.join(F.broadcast(sizes.select("bucket", parts)), "bucket")
    block = F.col("bucket") * (1 << 24) + F.floor(F.rand(17) * F.col("parts"))
    return rows.withColumn("block", block.cast("bigint")).drop("parts")


def _hits(queries: DataFrame, cands: DataFrame, width: int, k: int) -> DataFrame:
    """Each (block, chunk) task searches its block for its queries (id, ints, theta, block, chunk)."""
    needed = queries.select(F.col("block").alias("need_block"), F.col("chunk").alias("need_chunk")).distinct()
    needed = needed.select(F.col("need_block").alias("block"), F.col("need_chunk").alias("chunk"))
    sent = cands.join(needed, "block").select("block", "chunk", "id", "ints", "norm")
    asked = queries.select("block", "chunk", "id", "ints", "theta")
    search = _searcher(width, k)
    grouped = asked.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk"))
    return grouped.applyInPandas(lambda a, b: search(a, b), HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE,
          id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best candidates of ``vectors``.

    ``queries`` and ``vectors`` share the columns ``id_col`` and ``vector``; see
    the module text for the rules.  Blocks and queries are written to the shared
    folder, so a lost executor recomputes only its own tasks.
    """
    cands = saved(_blocked(integer_rows(vectors, scale, id_col, vector)))
    asked = integer_rows(queries, scale, id_col, vector).drop("norm")
    width = cands.select(F.max(F.size("ints"))).first()[0]
    if width is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_queries = asked.count()
    chunks = max(1, math.ceil(n_queries / QUERY_ROWS))
    asked = saved(asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))))

    stats = cands.groupBy("bucket", "block").agg(
        F.max("norm").alias("largest"),
        F.array(*[F.min(F.coalesce(F.get("ints", i), F.lit(0))) for i in range(width)]).alias("lo"),
        F.array(*[F.max(F.coalesce(F.get("ints", i), F.lit(0))) for i in range(width)]).alias("hi"),
    )
    stats = saved(stats)
    # a bounded number of rows: the blocks of greatest norm
    pilots = [r.block for r in stats.orderBy(F.desc("largest"), "block").limit(PILOT_BLOCKS).collect()]
    first = asked.withColumn("theta", F.lit(None).cast("double"))
    first = first.withColumn("block", F.explode(F.array(*[F.lit(b) for b in pilots])))
    pilot_hits = saved(_hits(first, cands, width, k))
    kth = _top(pilot_hits, k).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).cast("double").alias("theta"))

    bounded = asked.join(kth, asked["id"] == kth["query_id"], "left").drop("query_id")
    bounded = bounded.withColumn("qnorm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x)))
    # buckets: one row per factor RATIO of norms, a bounded list
    buckets = cands.groupBy("bucket").agg(F.max("norm").alias("largest")).collect()
    reach = F.array(*[F.struct(F.lit(r.bucket).alias("bucket"), F.lit(r.largest).alias("largest")) for r in buckets])
    open_bucket = lambda b: F.col("theta").isNull() | (
        F.col("qnorm") * b.largest * (1 + SLACK) + 1 >= F.col("theta"))
    pairs = bounded.withColumn("bucket", F.explode(F.transform(F.filter(reach, open_bucket), lambda b: b.bucket)))
    n_blocks = stats.count()
    if n_blocks <= BROADCAST_BLOCKS:
        pairs = pairs.join(F.broadcast(stats), "bucket")
    else:
        parts = max(1, math.ceil(n_blocks / (BLOCKS_PER_KEY * len(buckets))))
        keyed = stats.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        pairs = pairs.join(keyed, ["bucket", "part"]).drop("part")
    pairs = pairs.where(~F.col("block").isin(pilots))
    reachable = F.col("theta").isNull() | (
        (F.col("qnorm") * F.col("largest") * (1 + SLACK) + 1 >= F.col("theta"))
        & (_box_bound("ints", "lo", "hi") + 1 >= F.col("theta")))
    pairs = pairs.where(reachable).select("block", "chunk", "id", "ints", "theta")
    hits = pilot_hits.unionByName(_hits(pairs, cands, width, k))
    return _top(hits, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The registered search: rows whose ``vec_id`` is divisible by ``every`` ask, all rows answer."""
    queries = embeddings.where(F.col("vec_id") % every == 0)
    return top_k(embeddings, queries, k=k)
