"""Cross-tokenizer alignment against a brute-force version; the CSR product against dense matrices."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from patchloom.llm import token_alignment as T

TEXTS = [
    "Hello  world", "</s>[INST] ok [/INST] <|endoftext|>", "日本語のテキスト", "emoji 🙂🙂 end", "a\n\n\tb  ", "x",
    "The quick brown fox jumps over the lazy dog. " * 40, "naïve café — 100%", None, "", "Hello  world",
]


def by_hand(texts):
    aligner = T.Aligner(open(f"{T.TOKENIZERS}/{T.A_FILE}").read(), open(f"{T.TOKENIZERS}/{T.B_FILE}", "rb").read())
    docs = []
    for (a_ids, b_ids) in aligner.encode([t or "" for t in texts]):
        a_ends, b_ends, at = [], [], 0
        for i in a_ids:
            at += len(aligner.a_bytes[i])
            a_ends.append(at)
        at = 0
        for i in b_ids:
            at += len(aligner.b_bytes[i])
            b_ends.append(at)
        links = [(int(a), int(b)) for a, ea in zip(a_ids, a_ends) for b, eb in zip(b_ids, b_ends) if ea == eb]
        cuts = sorted(set(a_ends) & set(b_ends))
        parts = []
        for lo, hi in zip([0, *cuts], cuts):
            left = [str(a) for a, e in zip(a_ids, a_ends) if lo < e <= hi]
            right = [str(b) for b, e in zip(b_ids, b_ends) if lo < e <= hi]
            parts.append(",".join(left) + "|" + ",".join(right))
        text = ";".join(parts)
        docs.append((len(a_ids), len(b_ids), len(cuts), links, hashlib.sha256(text.encode()).hexdigest() if parts else ""))
    count = Counter(link for d in docs for link in d[3])
    best = {}
    for (a, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    return [(n_a, n_b, n_g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha)
            for n_a, n_b, n_g, links, sha in docs]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(T, "BROADCAST_PAIRS", 0)
    rows = [(i if i != 4 else None, t, "s", 1, 2) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row int, n_a int")
    got = T.aligned_documents(df).collect()
    assert len(got) == len(rows)
    want = by_hand(TEXTS)
    mine = sorted(((r.doc_id if r.doc_id is not None else 4), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best,
                   r.count_sum, r.groups_sha256) for r in got)
    assert mine == sorted((i, *w) for i, w in enumerate(want))
    empty = [r for r in got if r.doc_id in (8, 9)]
    assert all(r.n_a == r.n_b == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in empty)
    assert T.aligned_documents(df.limit(0)).count() == 0


def test_byte_bpe_ids_equal_the_files_own_tokenizer():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{T.TOKENIZERS}/{T.A_FILE}")
    reference.encode_special_tokens = True
    aligner = T.Aligner(open(f"{T.TOKENIZERS}/{T.A_FILE}").read(), open(f"{T.TOKENIZERS}/{T.B_FILE}", "rb").read())
    texts = [t for t in TEXTS if t] + ["it's we'll 12345 x\u00a0y  \n\n z", "<|endoftext|><|endoftext|>"]
    got = [a.tolist() for a, _ in aligner.encode(texts)]
    want = [e.ids for e in reference.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert got == want


def test_decimal_text():
    ids = np.array([0, 7, 10, 99, 100, 31999, 50255])
    seps = np.array([ord(c) for c in ",|,;,|"])
    assert T._decimal_text(ids, seps) == b"0,7|10,99;100,31999|50255"


def test_gustavson_equals_dense_product():
    random = np.random.default_rng(1)
    for _ in range(50):
        a_len = random.integers(1, 5, random.integers(0, 12))
        b_total = int(a_len.sum())
        cuts = np.sort(random.choice(np.arange(1, b_total), size=min(b_total - 1, 4), replace=False)) if b_total > 1 else []
        b_len = np.diff(np.concatenate(([0], cuts, [b_total]))).astype(np.int64) if b_total else np.empty(0, np.int64)
        a = T.incidence(a_len)
        bt = T.transposed(T.incidence(b_len)[0])
        rows, cols, values = T.gustavson(a, bt)
        dense_a = np.zeros((len(a_len), b_total), int)
        for i in range(len(a_len)):
            dense_a[i, a[0][i]:a[0][i + 1]] = 1
        dense_b = np.zeros((len(b_len), b_total), int)
        b_ptr = T.incidence(b_len)[0]
        for j in range(len(b_len)):
            dense_b[j, b_ptr[j]:b_ptr[j + 1]] = 1
        product = dense_a @ dense_b.T
        assert sorted(zip(rows.tolist(), cols.tolist(), values.tolist())) == sorted(
            (i, j, int(product[i, j])) for i, j in zip(*np.nonzero(product)))
