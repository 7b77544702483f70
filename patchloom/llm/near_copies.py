"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

No pair at or above the limit is missed.  A set's shingles are put in one order
for all sets: rare ones first, then by hash.  Two sets that are alike to
``ALIKE`` then share a shingle among the first fifth of each, so only these
first shingles meet by an exchange.  Pairs that sizes and positions still allow
are candidates; each candidate is verified by the exact similarity of the two
sets, in a join.  Verified pairs link, and linked texts form components.

Which shingles are frequent is read from a sample.  That sets the order and how
rows are dealt out, never the result.  A shingle that more than ``CROWD`` sets
begin with is taken in two steps: all its sets are compared with one of them;
after components are formed, only sets outside the shingle's largest component
are compared with the sets of other components.  A large family of near copies
so costs rows, not pairs.

Texts with equal sets are one node, so exact copies cost nothing.  A text of
less than five words is one shingle; null and empty texts are one empty set.
Nodes and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from patchloom.llm.shared import LOWER, broadcast_object, checked_broadcast, cut, private, received, saved
from patchloom.llm.simhash import components

SHINGLE = 5
#: Fixed value: the similarity from which texts are near copies, as a fraction.
ALIKE = (4, 5)
SEED = 42
SAMPLE_DOCS = 4096
FREQUENT = 8  # of the sample
CROWD = 64
SALTS = 64
BUSY = 256
PREFIX_ROWS = "token bigint, node bigint, n int, pos int, salt int"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, last = b" ".join(words), min(SHINGLE, len(words)) - 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(starts) - last].tolist(), ends[last:].tolist())
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, one of which every like set shares, and which of them are frequent."""
    many, counts = frequent
    rank = np.zeros(len(hashes), np.int64)
    if len(many):
        at = np.minimum(np.searchsorted(many, hashes), len(many) - 1)
        rank = np.where(many[at] == hashes, counts[at], 0)
    part, whole = ALIKE
    length = len(hashes) - -(-part * len(hashes) // whole) + 1
    first = np.lexsort((hashes, rank))[:length] if len(hashes) else np.empty(0, np.int64)
    return hashes[first], rank[first] > 0


@F.pandas_udf(LongType())
def _nodes(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([node_of(shingles(x)) for x in texts], np.uint64).view(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(x).view(np.int64) for x in texts], dtype=object)


def _frequent(texts: DataFrame, key: Column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and in how many."""
    every = max(1, size // SAMPLE_DOCS)
    held = texts.where(F.pmod(key, F.lit(every)) == 0).select(F.explode(_sets("text")).alias("token"))
    rows = held.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    tokens = rows["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy().astype(np.int64)[order]


def _prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, node, n, pos, salt): a row per text and first shingle; only frequent shingles have salts from 0 on."""
    sent = broadcast_object(docs.sparkSession, frequent)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = received(sent)
        for frame in frames:
            tokens, often, sizes, nodes, lengths = [], [], [], [], []
            for text in frame["text"]:
                hashes = shingles(text)
                own, many = prefix(hashes, known)
                tokens.append(own)
                often.append(many)
                sizes.append(len(hashes))
                nodes.append(node_of(hashes))
                lengths.append(len(own))
            if not lengths:
                continue
            length = np.array(lengths)
            salt = np.repeat(frame["row_hash"].to_numpy(np.int64) % SALTS, length)
            yield pd.DataFrame({
                "token": np.concatenate(tokens).view(np.int64),
                "node": np.repeat(np.array(nodes, np.uint64).view(np.int64), length),
                "n": np.repeat(np.array(sizes, np.int32), length),
                "pos": (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32),
                "salt": np.where(np.concatenate(often), salt, -1).astype(np.int32),
            })

    return docs.select("text", "row_hash").mapInPandas(first, PREFIX_ROWS)


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition sorted by token, but for tokens that one row alone has; salted ones stay."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat((rest, frame))
        tokens = frame["token"].to_numpy()
        # the last token may go on in the next batch
        whole = int(np.searchsorted(tokens, tokens[-1])) if len(tokens) else 0
        yield _repeated(frame.iloc[:whole])
        rest = frame.iloc[whole:].drop_duplicates(["token", "node"])
    if rest is not None:
        yield _repeated(rest)


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates(["token", "node"])
    return frame[(frame["salt"] >= 0) | frame["token"].duplicated(keep=False)].drop(columns="salt")


def _possible(a: str, b: str) -> Column:
    """Whether sizes and positions of a shared shingle leave room for the similarity."""
    part, whole = ALIKE
    most = f"least({a}.pos, {b}.pos) + 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1"
    return F.expr(f"""{whole} * least({a}.n, {b}.n) >= {part} * greatest({a}.n, {b}.n)
        AND {part + whole} * cast({most} AS bigint) >= {part} * ({a}.n + {b}.n)""")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike.

    Nodes of more than ``BUSY`` pairs are met under ``SALTS`` salts, others once.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    busy = cut(ends.groupBy("node").count().where(F.col("count") > BUSY).select("node", F.lit(True).alias("is_busy")))
    salted = pairs
    spread = cut(busy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("node", "salt"))
    # busy nodes are few, a part of all pairs over BUSY; broadcast only under a counted bound
    busy, spread = checked_broadcast(busy), checked_broadcast(spread)
    for side, other, values in (("a", "b", "x"), ("b", "a", "y")):
        salted = salted.join(busy.withColumnRenamed("node", side), side, "left")
        salt = F.when(F.col("is_busy"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0)
        salted = salted.withColumn("salt", salt).drop("is_busy")
        held = sets.join(spread, "node", "left")
        held = held.select(F.col("node").alias(side), F.coalesce("salt", F.lit(0)).cast("bigint").alias("salt"), F.col("tokens").alias(values))
        salted = salted.join(held, [side, "salt"]).drop("salt")
    part, whole = ALIKE
    both = F.size(F.array_intersect("x", "y"))
    return salted.where(whole * both >= part * (F.size("x") + F.size("y") - both)).select("a", "b")


def _labels(edges: DataFrame) -> DataFrame:
    return cut(components(edges))


def _components(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(node, root) of the nodes that link to others; ``docs`` has ``text``, ``key`` and ``row_hash``."""
    rows = _prefix_rows(docs, _frequent(docs, F.col("row_hash"), size))
    dealt = rows.repartition("token", "salt").sortWithinPartitions("token")
    shared = dealt.mapInPandas(_shared, "token bigint, node bigint, n int, pos int").dropDuplicates(["token", "node"])
    shared = saved(shared)
    counts = shared.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("node", "n", "pos")).alias("one"))
    counts = cut(counts.where("c > 1"))
    few = shared.join(counts.where(F.col("c") <= CROWD).select("token"), "token")
    small = few.alias("p").join(few.alias("q"), "token").where("p.node < q.node").where(_possible("p", "q"))
    crowds = counts.where(F.col("c") > CROWD).select("token", "one")
    # tokens of crowds are few, a part of all rows over CROWD; broadcast only under a counted bound
    crowded = saved(shared.join(checked_broadcast(crowds), "token"))
    star = crowded.alias("p").where("node <> one.node").where(_possible("p", "p.one"))
    pairs = small.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    pairs = cut(pairs.union(star.select(F.col("one.node").alias("a"), F.col("node").alias("b"))).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(crowded.select("node")).union(pairs.select("b")).distinct()
    texts = docs.join(reps.join(nodes, "node").select("key", "node"), "key").dropDuplicates(["node"])
    sets = saved(texts.select("node", _sets("text").alias("tokens")))
    edges = cut(_verified(pairs, sets))
    labels = _labels(edges)
    if crowded.isEmpty():
        return labels

    labelled = crowded.select("token", "node", "n", "pos").join(labels, "node", "left")
    labelled = cut(labelled.withColumn("root", F.coalesce("root", "node")))
    by_root = labelled.groupBy("token", "root").agg(F.count("*").alias("c"))
    major = by_root.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("k"))
    major = checked_broadcast(cut(major.where("k > 1")))
    open_rows = cut(labelled.join(major, "token"))
    minor = open_rows.where("root <> major").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = open_rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    cross = minor.alias("p").join(spread.alias("q"), ["token", "salt"])
    # between two minor rows one order is enough
    cross = cross.where("p.root <> q.root AND (q.root = q.major OR p.node < q.node)").where(_possible("p", "q"))
    more = cross.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
    found = _verified(cut(more.join(pairs, ["a", "b"], "left_anti")), sets)
    return _labels(edges.union(found))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least id (null last), with all its columns.

    Of identical rows one stays.
    """
    content = ["doc_id", "text"]
    key = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    own = docs.select("doc_id", "text", key.alias("key")).withColumn("row_hash", F.col("key.a"))
    rows = saved(own.select("doc_id", "key", _nodes("text").alias("node")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = cut(rows.groupBy("node").agg(F.min(order).alias("first")))
    reps = first.select("node", F.col("first.key").alias("key"))
    roots = _components(own, reps, rows.count())
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min("first").alias("first"))
    own = private(docs, "near_key")
    kept = saved(kept.select(F.col("first.key").alias(own)))
    return docs.join(kept, key == F.col(own)).dropDuplicates([own]).drop(own)
