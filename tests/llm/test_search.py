"""Exact top-k search against brute force, with the edge cases of its module text."""

import math

import numpy as np
import pytest

from patchloom.llm import topk_search

ROWS = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def by_hand(rows, every=100, k=10, scale=1024):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, *_ in rows if i is not None and usable(v)]
    scored = {}
    for qid, q in ok:
        if qid % every == 0:
            scored.setdefault(qid, []).extend((-sum(a * b for a, b in zip(q, c)), cid) for cid, c in ok if cid != qid)
    return sorted((qid, r + 1, cid, -s) for qid, got in scored.items() for r, (s, cid) in enumerate(sorted(got)[:k]))


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk_search, "PILOT_BLOCKS", 1)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_random_vectors_in_many_blocks(spark, small_blocks, monkeypatch, broadcast):
    monkeypatch.setattr(topk_search, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(topk_search, "BLOCKS_PER_KEY", 2)
    random = np.random.default_rng(3)
    rows = []
    for i in range(700):
        v = random.normal(0, 0.2 * (1 + i % 5), 8)
        if i % 9 == 0:
            v = rows[-1][1] if rows else v.tolist()  # copies of one vector under other ids
        rows.append((i, [float(x) for x in v], i % 3))
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(topk_search.search_embeddings(df)) == by_hand(rows)
    assert found(topk_search.search_embeddings(df, every=7, k=3)) == by_hand(rows, every=7, k=3)


def test_edge_cases(spark, small_blocks):
    rows = [
        (0, [0.5, 0.5, 0.0], 1),
        (100, [0.5, 0.5, 0.0], 1),  # a copy of query 0: ties broken by the smaller id
        (100, [0.25, 0.0, 0.0], 1),  # the query id twice: both rows ask, the best of both stay
        (200, None, 1),  # takes no part
        (300, [0.1, None, 0.2], 1),  # takes no part
        (400, [float("nan"), 0.1, 0.1], 1),  # takes no part
        (500, [float("inf"), 0.1, 0.1], 1),  # takes no part
        (None, [0.9, 0.9, 0.9], 1),  # no id: takes no part
        (600, [], 1),  # empty: scores 0
        (700, [0.0, 0.0, 0.0], 1),  # zero: scores 0
        (800, [0.3, 0.3], 1),  # shorter: scores over the components both have
        (5, [0.3, 0.3, 0.9], 1),
        (5, [0.3, 0.3, 0.9], 1),  # a repeated row stands twice
        (6, [-0.3, -0.3, -0.9], 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = found(topk_search.search_embeddings(df))
    assert got == by_hand(rows)
    assert [r for r in got if r[0] == 600] == [(600, 1, 0, 0), (600, 2, 5, 0), (600, 3, 5, 0), (600, 4, 6, 0),
                                                (600, 5, 100, 0), (600, 6, 100, 0), (600, 7, 700, 0), (600, 8, 800, 0)]
    assert {r[0] for r in got} == {0, 100, 600, 700, 800}
    assert topk_search.search_embeddings(df.limit(0)).count() == 0


def test_clashing_column_names(spark, small_blocks):
    rows = [(i, [float(i % 7) / 7, 1.0 - (i % 3) / 3], i % 2, 1, 2, 3, 4) for i in range(300)]
    cols = ROWS + ", id int, ints int, norm int, block int"
    df = spark.createDataFrame(rows, cols)
    assert found(topk_search.search_embeddings(df)) == by_hand([r[:3] for r in rows])
