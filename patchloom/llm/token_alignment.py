"""Cross-tokenizer alignment through token-byte incidence matrices.

A document is encoded twice, without special tokens (their strings in a text are
plain text): space + text by a byte-level BPE (A), text by a sentencepiece BPE
(B, which adds the space).  A token's bytes are its A entry decoded byte-level,
or its B piece in UTF-8 with U+2581 as space and <0xHH> as byte HH.

Per document, in a task: A and B become CSR incidence matrices of tokens by
bytes (row pointers are the token ends; B is kept transposed, bytes by tokens).
Gustavson's row-by-row product A·Bᵀ gives the overlap links, each with the
bytes it shares; links proper are those whose two byte ranges end together.
Offsets where A and B tokens both end cut the tokens into groups; the
group-incidence product G_A·G_Bᵀ links tokens that share a group
(``n_group_links`` counts its non-zeros from the symbolic phase, without
listing them, so a long group never builds its square).

Across the corpus, Spark counts how many links hold each (A id, B id) pair and
the highest count per B id.  A task sums its documents' links by pair before
anything leaves it.  The pair counts go back to the documents by a broadcast
where their number is below ``BROADCAST_PAIRS`` (counted first), else by a join
salted over ``SALTS`` parts, so a pair standing in every document never lands
in one task.

Edge cases: null, empty, or texts whose joined A or B bytes differ from
space + text get no tokens: zeros and an empty ``groups_sha256``.  Rows are kept
one by one, repeated rows and null ids included; their links count as often as
they stand.  Other columns of ``docs`` do not matter.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.shared import broadcast_object, received, saved

TOKENIZERS = "/opt/tokenizers"
A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
SALTS = 32
#: The pre-split of byte-level BPE (contractions, letters, digits, other runs, spaces).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pair counts are broadcast up to this many distinct (A id, B id) pairs, counted first; beyond, the join is salted.
BROADCAST_PAIRS = 2_000_000
#: Texts are encoded this many bytes at a time, so a batch of long documents stays small in a worker.
SLICE_BYTES = 1 << 20

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, "
           "n_group_links long, groups_sha256 string, link_a array<int>, link_b array<int>, link_n array<int>")


def _byte_values() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256, 257, ... in byte order."""
    own = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    values, extra = {}, 0
    for b in range(256):
        if b in own:
            values[chr(b)] = b
        else:
            values[chr(256 + extra)] = b
            extra += 1
    return values


class Aligner:
    """Both tokenizers, built in a task from file contents, with the byte length of every id."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.b_model = a_json, b_model
        self._ready = False

    def _load(self) -> None:
        import json

        import sentencepiece
        import tiktoken

        model = json.loads(self.a_json)
        special = {t["content"] for t in model.get("added_tokens", [])}
        values = _byte_values()
        vocab = {bytes(values[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        # A's merges are its vocabulary order, so the file's entries as ranks encode the same ids (tested against
        # the file's own tokenizer); special tokens' strings stay plain text
        self.a = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        size = max(model["model"]["vocab"].values()) + 1
        self.a_bytes = [b""] * size
        for token, i in vocab.items():
            self.a_bytes[i] = token
        fallback = re.compile(r"<0x([0-9A-Fa-f]{2})>")
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            hit = fallback.fullmatch(piece)
            self.b_bytes.append(bytes([int(hit.group(1), 16)]) if hit else piece.replace("▁", " ").encode("utf-8"))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self._ready = True

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) per text; empty arrays where a text gets no tokens."""
        if not self._ready:
            self._load()
        empty = (np.empty(0, np.int64), np.empty(0, np.int64))
        out = [empty] * len(texts)
        live = [i for i, t in enumerate(texts) if t]
        a_all = [self.a.encode_ordinary(" " + texts[i]) for i in live]
        b_all = self.b.encode([texts[i] for i in live], num_threads=1)
        for i, a, b in zip(live, a_all, b_all):
            whole = (" " + texts[i]).encode("utf-8")
            a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
            if self.a_len[a_ids].sum() != len(whole) or self.b_len[b_ids].sum() != len(whole):
                continue
            if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                continue
            out[i] = (a_ids, b_ids)
        return out


def incidence(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CSR (row pointers, column indices) of tokens by the bytes they cover."""
    pointers = np.concatenate(([0], np.cumsum(lengths)))
    return pointers, np.arange(pointers[-1], dtype=np.int64)


def transposed(pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CSR of bytes by tokens: every byte lies in exactly one token."""
    n_bytes = int(pointers[-1])
    owners = np.repeat(np.arange(len(pointers) - 1, dtype=np.int64), np.diff(pointers))
    return np.arange(n_bytes + 1, dtype=np.int64), owners


def gustavson(a: tuple[np.ndarray, np.ndarray], bt: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A·Bᵀ row by row: for row i, the rows of Bᵀ named by i's columns are merged and summed.

    Returns (row, column, value) of the non-zeros, rows ascending, columns ascending within a row.
    """
    a_ptr, a_idx = a
    bt_ptr, bt_idx = bt
    rows = np.repeat(np.arange(len(a_ptr) - 1, dtype=np.int64), np.diff(a_ptr))
    spans = bt_ptr[a_idx + 1] - bt_ptr[a_idx]
    rows = np.repeat(rows, spans)
    starts = np.repeat(bt_ptr[a_idx], spans)
    offsets = np.arange(len(starts)) - np.repeat(np.cumsum(spans) - spans, spans)
    cols = bt_idx[starts + offsets]
    if not len(rows):
        return rows, cols, rows
    key = rows * (int(cols.max()) + 1) + cols
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    values = np.diff(np.concatenate((np.flatnonzero(first), [len(key)])))
    return rows[order][first], cols[order][first], values


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> dict:
    """Groups, links and their digest for one document's two token sequences."""
    a_ptr, a_idx = incidence(a_len[a_ids])
    b_ptr, _ = incidence(b_len[b_ids])
    rows, cols, _ = gustavson((a_ptr, a_idx), transposed(b_ptr))
    a_end, b_end = a_ptr[1:], b_ptr[1:]
    together = a_end[rows] == b_end[cols]
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    # symbolic Gustavson of G_A·G_Bᵀ: row i has as many non-zeros as its group has B tokens
    b_per_group = np.bincount(b_group, minlength=len(cuts))
    ids = np.concatenate((a_ids, b_ids))
    group = np.concatenate((a_group, b_group))
    side = np.concatenate((np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)))
    order = np.lexsort((np.arange(len(ids)), side, group))
    group, side = group[order], side[order]
    seps = np.where(group[1:] != group[:-1], ord(";"), np.where(side[1:] != side[:-1], ord("|"), ord(",")))
    text = _decimal_text(ids[order], seps)
    return {
        "n_a": len(a_ids), "n_b": len(b_ids), "n_groups": len(cuts), "n_links": int(together.sum()),
        "n_overlaps": len(rows), "n_group_links": int(b_per_group[a_group].sum()),
        "groups_sha256": hashlib.sha256(text).hexdigest() if len(ids) else "",
        **_pairs(a_ids[rows[together]], b_ids[cols[together]]),
    }


def _decimal_text(ids: np.ndarray, seps: np.ndarray) -> bytes:
    """ASCII of ids in decimal, each followed by its separator byte (the last by none)."""
    if not len(ids):
        return b""
    places = len(str(int(ids.max())))
    powers = 10 ** np.arange(places - 1, -1, -1, dtype=np.int64)
    digits = (ids[:, None] // powers[None, :]) % 10 + 48
    width = np.maximum(1, np.floor(np.log10(np.maximum(ids, 1))).astype(np.int64) + 1)
    keep = np.arange(places)[None, :] >= places - width[:, None]
    table = np.column_stack((digits, np.append(seps, 0)))
    keep = np.column_stack((keep, np.arange(len(ids)) < len(ids) - 1))
    return table[keep].astype(np.uint8).tobytes()


def _pairs(a: np.ndarray, b: np.ndarray) -> dict:
    """Distinct (A id, B id) pairs of a document's links, with how many links hold each."""
    if not len(a):
        empty = np.empty(0, np.int32)
        return {"link_a": empty, "link_b": empty, "link_n": empty}
    pairs, n = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_counts=True)
    return {"link_a": (pairs >> 32).astype(np.int32), "link_b": (pairs & 0xFFFFFFFF).astype(np.int32),
            "link_n": n.astype(np.int32)}


#: Aligners already built in this worker, by a key of their files: built once, not once a task.
_BUILT: dict[str, Aligner] = {}


def _aligned(sent, key: str) -> callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = received(sent)
        aligner = _BUILT[key]
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SLICE_BYTES:
                    size, end = size + len(texts[end]), end + 1
                found = [align(a_ids, b_ids, aligner.a_len, aligner.b_len)
                         for a_ids, b_ids in aligner.encode(texts[at:end])]
                out = pd.DataFrame(found, columns=["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_group_links",
                                                   "groups_sha256", "link_a", "link_b", "link_n"])
                out.insert(0, "doc_id", frame["doc_id"].to_numpy()[at:end])
                out.insert(0, "row", frame["row"].to_numpy()[at:end])
                yield out
                at = end

    return run


def alignments(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row per document: row, doc_id, counts, ``groups_sha256`` and its links as (link_a, link_b) arrays."""
    spark = docs.sparkSession
    with open(f"{tokenizers}/{A_FILE}", encoding="utf-8") as a, open(f"{tokenizers}/{B_FILE}", "rb") as b:
        a_json, b_model = a.read(), b.read()
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    sent = broadcast_object(spark, Aligner(a_json, b_model))  # two vocabulary files, about 2 MB
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return saved(rows.mapInPandas(_aligned(sent, key), ALIGNED))


def aligned_documents(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and more) per row of ``docs``.

    A pair's count: the links that hold it, corpus-wide.  ``n_best``: links whose
    count is the highest of any pair with their B id (ties included);
    ``count_sum``: the counts of a document's links, summed.
    """
    found = alignments(docs, tokenizers)
    zipped = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))
    per_row = found.select("row", F.explode(zipped).alias("l")).select("row", "l.a", "l.b", "l.n")
    counts = per_row.groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    pairs = counts.join(best, "b")
    if pairs.count() <= BROADCAST_PAIRS:  # checked: at most BROADCAST_PAIRS rows of four numbers
        joined = per_row.join(F.broadcast(pairs), ["a", "b"])
    else:
        pairs = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = per_row.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = salted.join(pairs, ["a", "b", "salt"])
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = found.drop("link_a", "link_b", "link_n").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                      F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"),
                      "groups_sha256", "n_overlaps", "n_group_links")
