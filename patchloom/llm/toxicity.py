"""Toxicity: cumulative-link ordinal regression on sparse word features.

A text's features are its words and the first 4 and 5 bytes of longer words,
with the logarithm of one plus their counts.  All thresholds share the weights:
P(grade > k) = 1 / (1 + exp(cut[k] - weights . features)), cuts in order.  The
result is the expected severity, the sum of these over k.

Labels say toxic or not; grades come from them and the text: 0 for label 0, and
for label 1 one more than the number of limits in ``LIMITS`` that the count of
marker words reaches.  Markers are features that the sample's toxic documents
have far more often than the others.

Training takes at most ``PER_CLASS`` labelled documents of each class, those
with the least hashes, whole; of their features the ``FEATURES`` with the
strongest association reach the driver.  Every word of every document is scored.

Null and empty texts have no features and get the severity of the cuts alone.
Null labels are not used; a document with several labels takes the largest
(toxic if any label says so); repeated document rows are used.  Without
documents of both classes every severity is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.decontaminate import words_of
from patchloom.llm.shared import cut, id_remainder

PER_CLASS = 1500
FEATURES = 3000
LEAST_Z = 3.0
LIMITS = (3, 6)
PREFIXES = (4, 5)
ROUNDS = 400
RATE = 0.05
RIDGE = 1e-3
FOLDS = 5


def features_of(text: str | None) -> Counter[str]:
    """Counts of words and, with a mark in front, of the first bytes of longer words."""
    words = words_of(text)
    counts = Counter(words)
    for n in PREFIXES:
        counts.update(b"^" + w[:n] for w in words if len(w) > n)
    return counts


class Grades:
    """An ordinal model: named weights, and cuts in ascending order."""

    def __init__(self, names: list[str], n_grades: int):
        self.names = names
        self.weights = np.zeros(len(names))
        self.steps = np.zeros(n_grades - 1)  # the first cut, then logarithms of the distances

    def cuts(self) -> np.ndarray:
        return np.cumsum(np.concatenate((self.steps[:1], np.exp(self.steps[1:]))))

    def fit(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray) -> Grades:
        """Adam on the mean log-likelihood; the matrix is given by its entries."""
        state = [np.zeros(len(self.weights) + len(self.steps)) for _ in range(2)]
        docs = np.arange(len(grades))
        for turn in range(1, ROUNDS + 1):
            line = np.bincount(rows, self.weights[columns] * values, len(grades))
            cuts = self.cuts()
            bounds = np.concatenate(([-np.inf], cuts, [np.inf]))
            below = 1 / (1 + np.exp(-np.clip(bounds[None, :] - line[:, None], -40, 40)))
            below[:, 0], below[:, -1] = 0, 1
            low, high = below[docs, grades], below[docs, grades + 1]
            chance = np.maximum(high - low, 1e-9)
            slope_low, slope_high = low * (1 - low), high * (1 - high)
            to_line = (slope_low - slope_high) / chance / len(grades)
            to_cuts = np.zeros(len(cuts) + 2)
            np.add.at(to_cuts, grades + 1, slope_high / chance / len(grades))
            np.add.at(to_cuts, grades, -slope_low / chance / len(grades))
            to_cuts = to_cuts[1:-1]
            to_steps = np.cumsum(to_cuts[::-1])[::-1] * np.concatenate(([1.0], np.exp(self.steps[1:])))
            to_weights = np.bincount(columns, to_line[rows] * values, len(self.weights)) - RIDGE * self.weights
            gradient = np.concatenate((to_weights, to_steps))
            state[0] += 0.1 * (gradient - state[0])
            state[1] += 0.01 * (gradient**2 - state[1])
            move = RATE * state[0] / (1 - 0.9**turn) / (np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-8)
            self.weights += move[: len(self.weights)]
            self.steps += move[len(self.weights) :]
        return self


def above(line: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) per row and k."""
    return 1 / (1 + np.exp(-np.clip(line[:, None] - cuts[None, :], -40, 40)))


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for number, toxic, text in zip(frame["number"], frame["toxic"], frame["text"]):
            counts = features_of(text)
            if counts:
                names = np.array([x.decode("latin-1") for x in counts], object)
                yield pd.DataFrame({"number": number, "toxic": toxic, "feature": names, "n": list(counts.values())})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[dict[str, float], list[float]] | None:
    """Weights by feature and cuts; None where a class is missing."""
    known = labels.where(id_remainder(F.col("doc_id"), FOLDS) != 0).where(F.col(label).isNotNull())
    # a document labelled in several rows takes its largest label: toxic if any row says so
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(10))
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(PER_CLASS) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    chosen = cut(chosen.withColumn("number", F.xxhash64("doc_id", "text")))
    entries = cut(chosen.select("number", "toxic", "text").mapInPandas(_features, "number bigint, toxic int, feature string, n int"))
    sizes = {x.toxic: x.n for x in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    seen = entries.groupBy("feature").agg(*[F.count_if(F.col("toxic") == k).alias(f"n{k}") for k in (0, 1)])
    shares = [F.col(f"n{k}") / sizes[k] for k in (0, 1)]
    both = (F.col("n0") + F.col("n1")) / (sizes[0] + sizes[1])
    spread = F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1])) + 1e-9
    ranked = seen.select("feature", "n0", "n1", ((shares[1] - shares[0]) / spread).alias("z"))
    best = ranked.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).toPandas()
    used = entries.join(F.broadcast(entries.sparkSession.createDataFrame(best[["feature"]], "feature string")), "feature")
    matrix = used.toPandas()
    numbers = {x: i for i, x in enumerate(sorted(chosen.select("number").distinct().toPandas()["number"]))}
    toxic = np.zeros(len(numbers), int)
    for x in chosen.select("number", "toxic").toPandas().itertuples():
        toxic[numbers[x.number]] = x.toxic
    place = {x: i for i, x in enumerate(best["feature"])}
    rows = matrix["number"].map(numbers).to_numpy()
    columns = matrix["feature"].map(place).to_numpy()
    marker = ((best["n1"] / sizes[1]) > 20 * (best["n0"] + 0.5) / sizes[0]).to_numpy()
    marked = np.bincount(rows, matrix["n"].to_numpy() * marker[columns], len(numbers)) if len(matrix) else np.zeros(len(numbers))
    grades = np.where(toxic == 1, 1 + sum((marked >= x).astype(int) for x in LIMITS), 0)
    model = Grades(list(place), 2 + len(LIMITS))
    model.fit(rows, columns, np.log1p(matrix["n"].to_numpy(float)), grades)
    return dict(zip(model.names, model.weights.tolist())), model.cuts().tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], name: str = "severity_grades") -> DataFrame:
    """``docs`` and a struct of expected_severity, p_toxic and grade (the likeliest)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def severity(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, cuts = sent.value
        known = {x.encode("latin-1"): w for x, w in weights.items()}
        whole = {x: w for x, w in known.items() if not x.startswith(b"^")}
        starts = {n: {x[1:]: w for x, w in known.items() if x.startswith(b"^") and len(x) == n + 1} for n in PREFIXES}
        for texts in parts:
            lines = []
            for text in texts:
                words = words_of(text)
                counts = Counter(w for w in words if w in whole)
                line = sum(whole[w] * np.log1p(n) for w, n in counts.items())
                for size, own in starts.items():
                    counts = Counter(p for p in [w[:size] for w in words if len(w) > size] if p in own)
                    line += sum(own[p] * np.log1p(n) for p, n in counts.items())
                lines.append(line)
            over = above(np.array(lines, float), np.array(cuts))
            exact = -np.diff(np.column_stack((np.ones(len(over)), over, np.zeros(len(over)))), axis=1)
            yield pd.DataFrame({"expected_severity": over.sum(axis=1), "p_toxic": over[:, 0], "grade": exact.argmax(axis=1).astype("int32")})

    return docs.withColumn(name, severity("text"))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, expected_severity, p_toxic, grade, toxic."""
    own = docs.select("doc_id", "text")
    model = train(own, labels)
    if model is None:
        zero = F.lit(0.0)
        return own.select("doc_id", zero.alias("expected_severity"), zero.alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    rows = score(own, model).select("doc_id", "severity_grades.*")
    return rows.withColumn("toxic", F.col("p_toxic") >= 0.5)
