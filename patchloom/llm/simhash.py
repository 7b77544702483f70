"""SimHash near-duplicates with pivot distance tables.

A fingerprint's bit is 1 if it is set in more than half of the hashes of the
text's three-word shingles.  Fingerprints link at ``MOST_BITS`` or fewer
differing bits; linked texts form components.

Only distinct fingerprints are compared, so copies of one text cost nothing.
Two fingerprints that differ in three bits agree in one of four 16-bit blocks
and, among the other 48 bits, in one of four 12-bit parts: each fingerprint
goes to 16 buckets of a block and a part, and no linked pair is missed.  Inside
a bucket the Hamming distances to the reference fingerprints decide: by the
triangle inequality two linked fingerprints differ by at most three in every
coordinate.  The bucket is sorted by the first coordinate, so a sweep stops at
a gap of more than three; the other coordinates discard most of the rest; the
survivors are verified bit by bit.  A bucket returns links of a spanning
forest, fewer than it has rows, never its pairs.

Null texts count as empty; the empty text has fingerprint zero and links like
any other.  Rows with the same id stay rows of their own; a null id never
becomes a component's id unless the component holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from patchloom.llm.shared import LOWER, cut, saved

SHINGLE = 3
SEED = 42
MOST_BITS = 3
REFERENCES = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(16)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined, last = b" ".join(words), min(SHINGLE, len(words)) - 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist())]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.array([fingerprint(x) for x in texts], dtype=np.uint64)
    return pd.Series(values.view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """``docs`` with the fingerprint as a signed BIGINT of the same 64 bits."""
    return docs.withColumn(name, _fingerprints(F.col(text)))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _buckets(value: Column) -> Column:
    """The 16 keys of a fingerprint: table number, 16-bit block, 12-bit part of the rest."""
    keys = []
    for block in range(4):
        turn = 16 * (3 - block)
        turned = F.shiftleft(value, turn).bitwiseOR(F.shiftrightunsigned(value, 64 - turn)) if turn else value
        top = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        for part in range(4):
            low = F.shiftrightunsigned(turned, 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * block + part) << 28).bitwiseOR(top).bitwiseOR(low))
    return F.array(*keys)


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of each pair; a class is named by its least index."""
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]


def _forest(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, first of its class) over buckets that stand whole in ``keys``."""
    first = np.bitwise_count(prints ^ REFERENCES[0])
    order = np.lexsort((prints, first, keys))
    keys, prints = keys[order], prints[order]
    distances = np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    label, left, step = np.arange(len(keys)), np.arange(len(keys)), 1
    while len(left):
        left = left[left + step < len(keys)]
        right = left + step
        left = left[(keys[left] == keys[right]) & (distances[right, 0] - distances[left, 0] <= MOST_BITS)]
        right = left + step
        near = np.abs(distances[left] - distances[right]).max(axis=1, initial=0) <= MOST_BITS
        a, b = left[near], right[near]
        same = np.bitwise_count(prints[a] ^ prints[b]) <= MOST_BITS
        label = _merge(label, a[same], b[same])
        step += 1
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition sorted by bucket; the last bucket of a batch waits for the next batch."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(upto: int) -> pd.DataFrame:
        a, b = _forest(keys[:upto], prints[:upto])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for frame in frames:
        keys = np.concatenate((keys, frame["bucket"].to_numpy(np.int64)))
        prints = np.concatenate((prints, frame["simhash"].to_numpy(np.int64).view(np.uint64)))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield out(whole)
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield out(len(keys))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct values of column ``simhash`` within ``MOST_BITS`` of each other."""
    rows = prints.select("simhash", F.explode(_buckets(F.col("simhash"))).alias("bucket"))
    parts = rows.repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInPandas(_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) can reach.

    Large-star and small-star steps alternate until no edge changes, a number of
    rounds that grows with the logarithm of a component's length.
    """
    edges, before = cut(edges.where("a <> b")), None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if mark == before or not mark[0]:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = mark
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least).where("a <> b").distinct())


def _classes(prints: DataFrame) -> DataFrame:
    """(simhash, root) of rows with ``simhash``: fingerprints with the same root are connected."""
    distinct = cut(prints.select("simhash").distinct())
    roots = components(links(distinct)).select(F.col("node").alias("simhash"), "root")
    return distinct.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    ``component_id`` is the smallest id that can be reached over links.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = saved(with_fingerprints(own).select("doc_id", "simhash"))
    classes = cut(_classes(prints))
    least = prints.groupBy("simhash").agg(F.min("doc_id").alias("least_id"))
    named = least.join(classes, "simhash").groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = classes.join(named, "root").select("simhash", "component_id")
    rows = prints.join(known, "simhash")
    return rows.select("doc_id", hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least id (null last), with all its columns.

    Of identical rows one stays.  Columns of ``docs`` keep their names, whatever they are.
    """
    content = ["doc_id", "text"]
    key = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    own = docs.select("doc_id", "text", key.alias("key"))
    prints = saved(with_fingerprints(own).select("doc_id", "key", "simhash"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = prints.groupBy("simhash").agg(F.min(order).alias("first"))
    kept = first.join(_classes(prints), "simhash").groupBy("root").agg(F.min("first").alias("first"))
    name = "near_key" + "_" * max((len(c) for c in docs.columns), default=0)
    kept = saved(kept.select(F.col("first.key").alias(name)))
    return docs.join(kept, key == kept[name]).dropDuplicates([name]).drop(name)
