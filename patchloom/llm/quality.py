"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it.
Learned filters of ``WIDTH`` bytes slide over every position; each filter's
largest value in a chunk, the share of the chunk that is filled, and a small
hidden layer give the chunk's logit.  The mean of the chunks' logits, each
weighted by its bytes, gives the document's probability.

Training takes at most ``PER_CLASS`` labelled documents of each class, those
with the least hashes, and all the chunks that cover each of them; that sample
is all that reaches the driver.  Scoring reads every byte of every document,
and a document's score depends on its bytes alone, not on its neighbours in a
batch or a partition.

Null and empty texts are one empty chunk.  A null id counts as the empty text
where the fold is cut.  Labels of a document that stand in several rows are all
used; null labels are not.  If a class has no labelled document, all scores are
the share of label 1 among the labels, 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.shared import broadcast_object, id_remainder, received

PER_CLASS = 600
CHUNK = 512
BLOCK = 128  # chunks start at every second block
WIDTH = 6
FILTERS = 16
HIDDEN = 16
STEPS = 600
BATCH = 64
RATE = 0.01
THRESHOLD = 0.3
SLAB = 1 << 18  # bytes convolved at a time


class Network:
    """Weights and both passes; ``tables[w, byte]`` holds the filters' weights at offset ``w``."""

    def __init__(self, seed: int = 0):
        random = np.random.default_rng(seed)
        self.weights = {
            "tables": random.normal(0, 0.4, (WIDTH, 256, FILTERS)),
            "hidden": random.normal(0, 0.3, (FILTERS + 1, HIDDEN)),
            "shift": np.zeros(HIDDEN),
            "out": random.normal(0, 0.3, HIDDEN),
            "base": np.zeros(1),
        }

    def pooled(self, data: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Largest filter values per block of ``BLOCK`` positions; ``data`` has ``WIDTH`` - 1 more bytes.

        Positions where ``valid`` is false can't be the largest, as in training.
        """
        tables = self.weights["tables"].astype(np.float32)
        # two neighbouring bytes are looked up at once
        pairs = (tables[0::2, :, None, :] + tables[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)
        out = []
        for start in range(0, len(data) - WIDTH + 1, SLAB):
            part = data[start : start + SLAB + WIDTH - 1].astype(np.uint16)
            codes, n = part[:-1] * np.uint16(256) + part[1:], len(part) - WIDTH + 1
            values = pairs[0][codes[:n]]
            for k in range(1, WIDTH // 2):
                values += pairs[k][codes[2 * k : 2 * k + n]]
            values[~valid[start : start + n]] = -np.inf
            out.append(values.reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(out)

    def logits(self, maxima: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Row by row in a fixed order of sums (no matrix product, whose rounding follows the batch)."""
        w = self.weights
        features = np.column_stack((np.tanh(maxima), filled))
        hidden = np.tanh((features[:, :, None] * w["hidden"][None, :, :]).sum(axis=1) + w["shift"])
        return (hidden * w["out"][None, :]).sum(axis=1) + w["base"]

    def gradients(self, chunks: np.ndarray, filled: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(chunks)
        places = CHUNK - WIDTH + 1
        tables = w["tables"].astype(np.float32)
        values = tables[0][chunks[:, :places]]
        for k in range(1, WIDTH):
            values += tables[k][chunks[:, k : k + places]]
        # a position beyond the chunk's bytes can't be the largest, but for the first
        beyond = np.arange(places)[None, :] >= np.maximum(1, filled * CHUNK)[:, None]
        values[beyond] = -np.inf
        best = values.argmax(axis=1)
        maxima = np.tanh(np.take_along_axis(values, best[:, None, :], axis=1)[:, 0, :])
        features = np.column_stack((maxima, filled))
        hidden = np.tanh(features @ w["hidden"] + w["shift"])
        chance = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["base"], -30, 30)))
        error = (chance - labels) / n
        back = error[:, None] * w["out"] * (1 - hidden**2)
        to_maxima = (back @ w["hidden"].T)[:, :FILTERS] * (1 - maxima**2)
        tables = np.zeros_like(w["tables"])
        for k in range(WIDTH):
            seen = np.take_along_axis(chunks, best + k, axis=1)
            np.add.at(tables[k], (seen, np.arange(FILTERS)[None, :]), to_maxima)
        return {
            "tables": tables,
            "hidden": features.T @ back,
            "shift": back.sum(axis=0),
            "out": hidden.T @ error,
            "base": error.sum(keepdims=True),
        }

    def fit(self, chunks: np.ndarray, filled: np.ndarray, labels: np.ndarray, seed: int = 0) -> Network:
        """``STEPS`` steps of Adam over shuffled batches."""
        random, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        while step < STEPS:
            order = random.permutation(len(chunks))
            for at in range(0, len(order), BATCH)[: STEPS - step]:
                own = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(chunks[own], filled[own], labels[own]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    size = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.weights[k] = self.weights[k] - RATE * size
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts, each a function of its own bytes alone.

        Every text starts at a block and is followed by at least ``WIDTH`` - 1 zero
        bytes of its own, so no filter reads a neighbour; positions at and beyond
        a text's end (but for its first) are masked, as in training.
        """
        blocks = [max(1, -(-(len(x) + WIDTH - 1) // BLOCK)) for x in texts]
        data = np.frombuffer(b"".join(x.ljust(n * BLOCK, b"\0") for x, n in zip(texts, blocks)) + bytes(WIDTH - 1), np.uint8)
        ends = np.cumsum(blocks) * BLOCK
        lengths = np.array([max(1, len(x)) for x in texts], np.int64)
        place = np.arange(ends[-1] if len(texts) else 0) - np.repeat(ends - np.array(blocks) * BLOCK, np.array(blocks) * BLOCK)
        valid = place < np.repeat(lengths, np.array(blocks) * BLOCK)
        maxima = self.pooled(data, valid)
        doc_of, starts, sizes, at = [], [], [], 0
        for number, (text, n) in enumerate(zip(texts, blocks)):
            for first in range(0, max(1, n - CHUNK // BLOCK + 2), 2):
                doc_of.append(number)
                starts.append(at + first)
                sizes.append(min(CHUNK, len(text) - first * BLOCK))
            at += n
        starts_, doc_of_ = np.array(starts), np.array(doc_of)
        last = np.cumsum(blocks)[doc_of_] - 1
        pooled = np.max([maxima[np.minimum(starts_ + k, last)] for k in range(CHUNK // BLOCK)], axis=0)
        filled = np.array(sizes) / CHUNK
        weight = np.maximum(filled, 1 / CHUNK)
        total = np.bincount(doc_of_, self.logits(pooled, filled) * weight, len(texts))
        logit = total / np.bincount(doc_of_, weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5) -> pd.DataFrame:
    """At most ``PER_CLASS`` documents a class outside the held-out fold: label, chunks of bytes."""
    known = labels.where(id_remainder(F.col("doc_id"), folds) != 0).where(F.col(label).isNotNull())
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    zeros, ones = (known.where(F.col("label") == k).orderBy(order, "doc_id").limit(PER_CLASS) for k in (0, 1))
    # chunks of CHUNK characters start every half chunk and cover the whole text
    size = F.greatest(F.length("text"), F.lit(1))
    count = F.greatest(F.lit(1), F.ceil((size - CHUNK) / (CHUNK // 2)) + 1)
    starts = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: k * (CHUNK // 2))
    chunks = F.transform(starts, lambda at: F.encode(F.substr("text", at + 1, F.lit(CHUNK)), "utf-8"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = own.join(F.broadcast(zeros.union(ones)), "doc_id")
    return chosen.select("doc_id", "label", chunks.alias("chunks")).orderBy(order, "doc_id", "label").toPandas()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> Network | float:
    """A network fitted to the sample, or a constant where a class is missing."""
    sample = training_sample(docs, labels, label, folds)
    kinds = sample["label"].to_numpy()
    if len(set(kinds)) < 2:
        return float(kinds.mean()) if len(kinds) else 0.5
    rows = [(bytes(x)[:CHUNK], y) for many, y in zip(sample["chunks"], kinds) for x in many]
    # classes weigh the same: the smaller one is repeated
    share = [sum(y == k for _, y in rows) for k in (0, 1)]
    rows += [r for r in rows if r[1] == int(share[1] < share[0])] * (max(share) // min(share) - 1)
    data = np.frombuffer(b"".join(x.ljust(CHUNK, b"\0") for x, _ in rows), np.uint8).reshape(-1, CHUNK)
    filled = np.array([len(x) / CHUNK for x, _ in rows])
    return Network().fit(data, filled, np.array([y for _, y in rows], float))


def score(docs: DataFrame, network: Network | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the probability of label 1."""
    if isinstance(network, float):
        return docs.withColumn(name, F.lit(network))
    sent = broadcast_object(docs.sparkSession, network)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = received(sent)
        for texts in parts:
            data, scores = [(x or "").encode("utf-8", "replace") for x in texts], []
            at = 0
            while at < len(data):
                end, size = at, 0
                while end < len(data) and (size < SLAB or end == at):
                    size, end = size + len(data[end]) + BLOCK, end + 1
                scores.append(own.score(data[at:end]))
                at = end
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return docs.withColumn(name, probability(F.col(text)))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", "text")
    rows = score(own, train(own, labels))
    return rows.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= THRESHOLD).drop(name)
