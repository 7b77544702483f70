"""Hard-negative mining against brute force, with the edge cases of its module text."""

import math

import numpy as np
import pytest

from patchloom.llm import hard_negatives

ROWS = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, k=5):
    ok = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for aid, a, alab in {(i, tuple(v), lab) for i, v, lab in ok if i % 100 == 0}:
        pos = sorted((-dot(a, v), i) for i, v, lab in ok if lab == alab and i != aid)[:k]
        for ps, pid in pos:
            ps = -ps
            neg = sorted((-dot(a, v), i) for i, v, lab in ok
                         if lab != alab and i != aid and 80 * ps <= 100 * dot(a, v) <= 100 * ps)[:k]
            out |= {(aid, pid, r + 1, nid, ps, -ns) for r, (ns, nid) in enumerate(neg)}
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in df.collect())


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 2)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_random_vectors_in_many_leaves(spark, small_leaves, monkeypatch, broadcast):
    monkeypatch.setattr(hard_negatives, "BROADCAST_NODES", broadcast)
    monkeypatch.setattr(hard_negatives, "SALTS", 3)
    random = np.random.default_rng(5)
    rows = []
    for i in range(900):
        v = random.normal(0.1, 0.3, 6)
        if i % 11 == 0 and rows:
            v = rows[-1][1]  # one vector under many ids: ties broken by id
        rows.append((i, [float(x) for x in v], int(random.integers(0, 3))))
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = found(hard_negatives.mine(df))
    assert got == by_hand(rows) and len(got) > 100


def test_edge_cases(spark, small_leaves):
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.45, 0.5], 1), (3, [0.4, 0.5], 2), (4, [0.45, 0.5], 2),
        (14, [0.5, 0.45], 0),  # divisible by 7: label 1
        (100, [0.3, 0.3], 2), (101, [0.3, 0.3], 2), (102, [0.2, 0.3], 3), (103, [0.3, 0.3], 3),
        (200, None, 1), (300, [0.1, None], 1), (400, [float("nan"), 0.1], 1), (500, [0.1, 0.1], None),
        (None, [0.9, 0.9], 1), (600, [], 4), (601, [], 4), (602, [0.1, 0.1], 5),
        (700, [0.5], 0),  # divisible by 7 and 100: label 1; shorter vector
        (5, [0.3, 0.3], 2), (5, [0.3, 0.3], 2),  # a repeated row stands twice
        (800, [-0.5, -0.5], 1), (801, [0.5, 0.5], 1), (802, [-0.45, -0.45], 2),  # negative scores: no window
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = found(hard_negatives.mine(df))
    assert got == by_hand(rows)
    assert {r[0] for r in got} <= {0, 100, 600, 700, 800}
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_clashing_column_names(spark, small_leaves):
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(0, 0.3, 3)], i % 3, 1, 2, 3, 4, 5) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS + ", id int, ints int, leaf int, node int, key int")
    assert found(hard_negatives.mine(df)) == by_hand([r[:3] for r in rows])
