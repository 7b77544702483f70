"""Near copies of the pipeline's stage against brute force over five-word shingles."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from patchloom.llm import shared
from patchloom.llm import near_copies, simhash
from patchloom.llm.shared import LOWER

DOCS = "doc_id bigint, text string"


def kept_by_hand(docs):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().translate(LOWER).split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in holders[s]).items():
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {find(i) for i in sets}


def test_jaccard_near_copies_finds_all(spark):
    # the pipeline's stage calls SimHash with op9's contract (test_dedup.py); this operator stays in the library
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = near_copies.keep_one(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    # three bits of a fingerprint leave some of them in
    assert simhash.keep_one(docs).count() > len(got)


@pytest.mark.parametrize("crowd,busy,broadcast", [(4, 256, 10**6), (64, 256, 10**6), (64, 2, 10**6), (4, 2, 0)])
def test_families_and_shared_passages(spark, monkeypatch, crowd, busy, broadcast):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "BUSY", busy)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    random = np.random.default_rng(3)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, "a b c"), (-3, "A b  c"), (-3, "A b  c"), (-2, None), (-1, "")]
    for i in range(400):
        base = [f"{'uvw'[i % 3]}{k}" for k in range(60)]
        for at in random.integers(0, 60, random.integers(0, 4)):
            base[at] = f"x{i}"
        rows.append((i, " ".join(base) if i % 4 else f"{passage} " + " ".join(f"y{i}{k}" for k in range(random.integers(4, 20)))))
    want = kept_by_hand([r for r in rows if r[0] is not None])
    got = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0
