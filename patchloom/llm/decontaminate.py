"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items.  It reads a
document's words one by one and knows the length of the longest run that ends
at each word and stands in some item.  A window is ``WINDOW`` consecutive item
words, or a whole shorter item; a document word inside any occurrence of a
window is hit.

Words that no item has can't be inside a window, so only runs of item words as
long as the shortest window are fed to the automaton.  Items go into automata
of at most ``BLOCK_WORDS`` words each; a larger benchmark takes several passes,
whose hits are merged per document, so what is broadcast has a fixed bound.

Null texts have no words.  A null item id is the empty text among the item ids;
items with the same id count once.  Repeated document rows stay rows of their
own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from patchloom.llm.shared import broadcast_object, private, received

WINDOW = 13
COVERAGE = 20
BLOCK_WORDS = 100_000
#: Words are runs of digits, letters and bytes beyond ASCII, in lower case.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


@dataclass
class Automaton:
    """A suffix automaton of several word lists."""

    window: int = WINDOW
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    following: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    items: list[set[int]] = field(default_factory=lambda: [set()])
    whole: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    known: set[bytes] = field(default_factory=set)
    shortest: int = 0
    #: Per state, the nearest state up its suffix chain (itself included) that holds a window or ends a
    #: short item; 0 where none does.  A chain holds at most one window state and one such state per
    #: length below the window, so reporting a word visits a bounded number of states.
    jump: list[int] = field(default_factory=list)

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.following.append(following)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, word: bytes, child: int) -> int:
        """The state of ``parent``'s longest run followed by ``word``, taken out of ``child``."""
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.following[child]))
        self.link[child] = copy
        while parent >= 0 and self.following[parent].get(word) == child:
            self.following[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.following[last]:
            return self._split(last, word, self.following[last][word])
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.following[at]:
            self.following[at][word] = new
            at = self.link[at]
        if at >= 0:
            # appended first, so that the link is set to an existing state
            self.link[new] = self._split(at, word, self.following[at][word])
        return new

    def fill(self, texts: list[list[bytes]]) -> Automaton:
        """Add all items; item numbers are positions in ``texts``."""
        for words in texts:
            last = 0
            for word in words:
                last = self._extend(last, word)
            self.known.update(words)
        for number, words in enumerate(texts):
            at = 0
            for place, word in enumerate(words):
                at = self.following[at][word]
                if place + 1 >= self.window:
                    # the state of the last `window` words
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    self.items[at].add(number)
            if 0 < len(words) < self.window:
                self.whole.setdefault(at, []).append((len(words), number))
        sizes = [min(len(x), self.window) for x in texts if x]
        self.shortest = min(sizes, default=0)
        self.jump = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            held = bool(self.items[state]) or state in self.whole
            self.jump[state] = state if held else self.jump[self.link[state]]
        return self

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (start, end), merged and in order, and the items with occurring windows."""
        ranges: list[list[int]] = []
        found: set[int] = set()
        if not self.shortest:
            return [], found
        mask = bytes(map(self.known.__contains__, words))
        for run in re.finditer(b"\\x01{%d,}" % self.shortest, mask):
            at = size = 0
            for place in range(run.start(), run.end()):
                word = words[place]
                while at and word not in self.following[at]:
                    at = self.link[at]
                    size = self.length[at]
                if word in self.following[at]:
                    at = self.following[at][word]
                    size += 1
                widest, up = 0, self.jump[at]
                while up > 0:
                    if size >= self.window and self.items[up]:
                        widest = self.window
                        found |= self.items[up]
                    for length, number in self.whole.get(up, ()):
                        if length <= size:
                            widest = max(widest, length)
                            found.add(number)
                    up = self.jump[self.link[up]]
                if widest:
                    start = place + 1 - widest
                    while ranges and ranges[-1][1] >= start:
                        start = min(start, ranges.pop()[0])
                    ranges.append([start, place + 1])
        return [(a, b) for a, b in ranges], found


def automata(
    benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> Iterator[tuple[Automaton, list[str]]]:
    """Automata over blocks of the items, each with its items' ids."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)))).first()[0] or 0
    blocks = -(-size // block_words) or 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Automaton(window).fill([words_of(x.text) for x in own]), [x.item_id or "" for x in own]


FOUND = "struct<n_words: bigint, spans: array<struct<start: bigint, `end`: bigint>>, items: array<string>>"


def _searcher(broadcast: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        (automaton, ids), rows = received(broadcast), []
        for text in texts:
            words = words_of(text)
            ranges, found = automaton.find(words)
            spans = [{"start": a, "end": b} for a, b in ranges]
            rows.append((len(words), spans, sorted({ids[x] for x in found})))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a text's hits from several automata."""
    spans: list[dict[str, int]] = []
    for a, b in sorted((x["start"], x["end"]) for found in frame["found"] for x in found["spans"]):
        if spans and spans[-1]["end"] >= a:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b})
    items = sorted({x for found in frame["found"] for x in found["items"]})
    found = {"n_words": frame["found"][0]["n_words"], "spans": spans, "items": items}
    return pd.DataFrame({"hash": frame["hash"][:1], "found": [found]})


def with_hits(
    docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` and a column ``name``: n_words, spans of hit words, ids of the items found.

    Spans are word positions, start included and end not, and don't touch.  With
    several automata each text is searched once per automaton, and what was
    found joins the rows by the text's hash.
    """
    blocks = automata(benchmark, window, block_words)
    search = [_searcher(broadcast_object(docs.sparkSession, block)) for block in blocks]
    if len(search) == 1:
        return docs.withColumn(name, search[0](F.col("text")))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    passes = [docs.select(sha.alias("hash"), one(F.col("text")).alias("found")) for one in search]
    hits = reduce(DataFrame.unionByName, [x.where("size(found.spans) > 0") for x in passes])
    merged = hits.dropDuplicates().groupBy("hash").applyInPandas(_merge, f"hash string, found {FOUND}")
    own_hash, own_key = private(docs, f"{name}_hash"), private(docs, f"{name}_key")
    merged = merged.select(F.col("hash").alias(own_hash), F.col("found").alias(name))
    rows = docs.withColumn(own_key, sha).join(merged, F.col(own_key) == F.col(own_hash), "left")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    nothing = F.struct(words.alias("n_words"), F.array().alias("spans"), F.array().alias("items")).cast(FOUND)
    return rows.withColumn(name, F.coalesce(name, nothing)).drop(own_key, own_hash)


def _hit_words(found: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.aggregate(f"{found}.spans", zero, lambda total, x: total + x["end"] - x["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Digest per document; contaminated: at least one of ``coverage`` words is hit."""
    rows = with_hits(docs.select("doc_id", "text"), benchmark, "found").select("doc_id", "found")
    return rows.withColumn("n_hit", _hit_words("found")).select(
        "doc_id",
        "found.n_words",
        "n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("found.n_words"))).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from each span's first word to its last."""
    data = text.encode("utf-8", "replace")
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", data.translate(WORDS))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8")


@F.pandas_udf(StringType())
def _without_spans(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
    pairs = ([(x["start"], x["end"]) for x in spans] for spans in found["spans"])
    return pd.Series([without_spans(text, spans) for text, spans in zip(texts, pairs)])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, cut_spans: bool = False
) -> DataFrame:
    """``docs`` without what the benchmark contaminates; all columns stay.

    Documents with at least one of ``coverage`` words hit go.  With
    ``cut_spans`` they stay and lose the hit spans instead.  Documents below the
    limit are not touched.
    """
    name = "found"
    while name in docs.columns:
        name += "_"
    rows = with_hits(docs, benchmark, name)
    hit = _hit_words(name)
    over = (hit > 0) & (coverage * hit >= F.col(f"{name}.n_words"))
    if cut_spans:
        text = F.when(over, _without_spans("text", name)).otherwise(F.col("text"))
        return rows.withColumn("text", text).drop(name)
    return rows.where(~over).drop(name)
