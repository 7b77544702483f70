"""Quality, language model and toxicity: held-out figures and edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from patchloom.llm import context_mixing, quality, toxicity
from patchloom.llm.shared import LOWER

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_quality_on_the_held_out_fold(tables):
    rows = quality.classified(tables["documents"], tables["labels"])
    joined = rows.join(tables["labels"], "doc_id").where("held_out").toPandas()
    assert rows.count() == tables["documents"].count()
    assert (joined["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in joined["doc_id"]]).all()
    good = joined[joined["quality"] == 1]["score"].to_numpy()
    bad = joined[joined["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= quality.THRESHOLD).mean() > 0.97


def test_chunks_cover_all_bytes():
    network = quality.Network()
    text = bytes(range(256)) * 11 + b"end"
    whole = network.score([text, b"", b"ab"])
    assert network.score([text])[0] == pytest.approx(whole[0])
    for at in (0, 700, len(text) - 1):
        changed = text[:at] + b"\xff\x00\xff\x00\xff\x00\xff\x00"[: len(text) - at] + text[at + 8 :]
        valid = np.arange(24 * 128) < len(text)
        maxima = [network.pooled(np.frombuffer(x.ljust(24 * 128, b"\0") + bytes(5), np.uint8), valid)
                  for x in (text, changed)]
        assert not np.array_equal(*maxima)


def test_scores_do_not_depend_on_neighbours():
    network = quality.Network(2)
    random = np.random.default_rng(4)
    texts = [bytes(random.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 6, 122, 123, 128, 250, 256, 512, 1000, 3000)]
    texts += [b"\xff" * 128, b"a" * 1024]
    alone = [network.score([t])[0] for t in texts]
    for turn in range(4):
        order = random.permutation(len(texts))
        batch = network.score([texts[i] for i in order])
        assert [batch[list(order).index(i)] for i in range(len(texts))] == alone
    assert network.score([texts[3], texts[3]]).tolist() == [alone[3], alone[3]]


def test_scores_do_not_depend_on_partitions(spark, tables):
    docs = tables["documents"].limit(300).cache()
    network = quality.train(docs, tables["labels"])
    one = {r.doc_id: r.score for r in quality.score(docs.coalesce(1), network).collect()}
    seven = {r.doc_id: r.score for r in quality.score(docs.repartition(7), network).collect()}
    assert one == seven


def test_gradients_match_differences():
    random = np.random.default_rng(1)
    network = quality.Network(3)
    chunks = random.integers(0, 256, (4, quality.CHUNK)).astype(np.uint8)
    filled, labels = np.array([1.0, 0.5, 1.0, 0.25]), np.array([0.0, 1.0, 1.0, 0.0])
    chunks[1, 256:] = 0
    got = network.gradients(chunks, filled, labels)

    def loss():
        maxima = []
        for row, share in zip(chunks, filled):
            n = max(1, min(quality.CHUNK - quality.WIDTH + 1, int(share * quality.CHUNK)))
            tables = network.weights["tables"].astype(np.float32)
            values = sum(tables[k][row[k : k + n]] for k in range(quality.WIDTH))
            maxima.append(values.max(axis=0))
        line = network.logits(np.array(maxima), filled)
        return np.mean(np.log1p(np.exp(line)) - labels * line)

    for name in ("hidden", "shift", "out", "base"):
        weights = network.weights[name]
        at = tuple(0 for _ in weights.shape)
        step = 1e-4
        weights[at] += step
        above = loss()
        weights[at] -= 2 * step
        below = loss()
        weights[at] += step
        assert got[name][at] == pytest.approx((above - below) / (2 * step), abs=1e-5)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "y" * 70_000)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.classified(docs, none).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)] + [(7, None, None)], LABELS)
    some = spark.createDataFrame([(i, "good words" if i % 2 else "!!!!") for i in range(1, 5)] + [(7, None), (8, "")], DOCS)
    rows = quality.classified(some.unionAll(docs), both).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classified(spark.createDataFrame([], DOCS), both).count() == 0
    named = some.selectExpr("*", "1 AS score", "'a' AS lang")
    assert quality.accepted(named, both).columns == ["doc_id", "text", "score", "lang"]


def base_scores(docs):
    train = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    words = Counter(w for t in train for w in t.encode().translate(LOWER).split())
    n, ends = sum(words.values()) + len(train), len(train)
    v = len(words) + (1 if ends else 0)

    def log(c):
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    for i, t in docs:
        own = t.encode().translate(LOWER).split()
        yield i, len(own) + 1, sum(w in words for w in own) + bool(ends), n, sum(log(words[w]) for w in own) + log(ends)


def test_base_score_and_held_out_gain(tables):
    rows = context_mixing.scored(tables["documents"]).toPandas().set_index("doc_id")
    docs = [(r.doc_id, r.text or "") for r in tables["documents"].select("doc_id", "text").collect()]
    for i, tokens, known, total, score in base_scores(docs):
        row = rows.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (tokens, known, total)
        assert row.base_score == pytest.approx(score)
    held = rows[rows["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (rows["score"] < 0).all()


def test_counts_hold_all_documents_of_any_length(spark):
    words = [f"w{k % 7} v{k % 11}" for k in range(60)]
    docs = [(i, " ".join(words)) for i in range(40)] + [(100 + i, " ".join(words[i:] * 100)) for i in range(3)]
    own = spark.createDataFrame(docs, DOCS).selectExpr("*", "false AS held_out")
    sample = context_mixing._sample(own, len(docs))
    # pieces of long texts are in the sample, and a whole corpus of them has one
    assert len(sample) == 43 and max(len(t) for t, _ in sample) == context_mixing.SAMPLE_CHARS
    assert len({h for _, h in sample}) == 4
    vocabulary = sorted({w.encode() for x in words for w in x.split()})
    model = context_mixing.Model(vocabulary, np.full(18, 9), np.arange(18) % 8, 43, 0)
    copies = next(h for t, h in sample if t == docs[0][1].encode())
    without, full = context_mixing._slot_tables(own, model, {copies})

    def by_hand(texts):
        zeros, ones = model.seen([t.encode() for t in texts])
        return context_mixing.quantised(zeros, ones)

    assert (full == by_hand(t for _, t in docs)).all()
    assert (without == by_hand(t for _, t in docs[40:])).all() and (without != full).any()


def test_spelled_words_and_codes_are_proper():
    counts = np.array([4, 0, 8, 1, 1])  # one is added to each
    code = context_mixing.Code(counts)
    assert sum(0.5**n for n in code.length) == pytest.approx(1)
    assert ((counts + 1) * code.length).sum() == 37  # the least possible


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a a a b"), (3, "a a a b"), (None, "c" * 3000), (4, "a b\x0bc")], DOCS)
    rows = context_mixing.scored(docs).collect()
    assert len(rows) == 6 and all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert context_mixing.scored(spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity_on_the_held_out_fold(tables):
    rows = toxicity.graded(tables["documents"], tables["labels"])
    joined = rows.join(tables["labels"].withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    held = joined[[zlib.crc32(str(i).encode()) % 5 == 0 for i in joined["doc_id"]]]
    assert (held["toxic"] == (held["label"] == 1)).mean() > 0.95
    assert not joined[(joined["label"] == 0)]["toxic"].any()
    assert joined["expected_severity"].between(0, 3).all()


def test_ordinal_fit_orders_grades():
    rows = np.repeat(np.arange(90), 1)
    grades = np.repeat([0, 1, 2], 30)
    values = grades + 1.0
    model = toxicity.Grades(["w"], 3).fit(rows, np.zeros(90, int), values, grades)
    assert model.weights[0] > 0 and (np.diff(model.cuts()) > 0).all()
    severity = toxicity.above(model.weights[0] * np.array([1.0, 2.0, 3.0]), model.cuts()).sum(axis=1)
    assert severity[0] < severity[1] < severity[2]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "idiot " * 9000)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.expected_severity for r in toxicity.graded(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 40)] + [(50, None, None)], LABELS)
    some = spark.createDataFrame([(i, "fine words idiot" if i % 2 else "fine words") for i in range(1, 40)], DOCS)
    rows = toxicity.graded(some.unionAll(docs), labels).collect()
    assert len(rows) == 43 and all(0 <= r.expected_severity <= 3 for r in rows)


def test_toxicity_conflicting_labels_take_the_largest(spark):
    some = spark.createDataFrame([(i, "fine words idiot" if i % 2 else "fine words") for i in range(1, 40)], DOCS)
    rows = [(i, 1, int(i % 2)) for i in range(1, 40)]
    clash = [(2, 1, 1), (4, 1, 1)]
    one = spark.createDataFrame(rows + clash, LABELS)
    other = spark.createDataFrame(clash + rows[::-1], LABELS).repartition(3)
    first = {r.doc_id: r.expected_severity for r in toxicity.graded(some, one).collect()}
    second = {r.doc_id: r.expected_severity for r in toxicity.graded(some, other).collect()}
    assert first == second


def folds(n):
    """The first ``n`` training ids and the first ``n`` held-out ids."""
    held = [i for i in range(40 * n) if zlib.crc32(str(i).encode()) % 10 == 0]
    return [i for i in range(40 * n) if i not in held][:n], held[:n]


def test_words_beyond_the_lexicon_cost_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "LEXICON", 4)
    train, held = folds(60)
    docs = [(i, "a b c d " * 5 + "often once%d" % i + (" pair" if k < 2 else "")) for k, i in enumerate(train)]
    docs += [(held[0], "a often b"), (held[1], "a pair b"), (held[2], "a fresh b"), (held[3], "a once%d b" % train[0])]
    rows = {r.doc_id: r for r in context_mixing.scored(spark.createDataFrame(docs, DOCS)).collect()}
    often, pair, fresh, once = (rows[i].score for i in held[:4])
    assert often - pair == pytest.approx(np.log10(60 / 2))
    # what is seen once tells how often a new word comes: both are spelled
    assert fresh < pair and once < pair


def test_weights_and_classes_come_from_every_training_document(spark):
    words = [f"w{k % 7} v{k % 11}" for k in range(60)]
    docs = [(i, " ".join(words[i % 13 :] * (1 + i % 5))) for i in range(3000)]
    vocabulary = sorted({w.encode() for x in words for w in x.split()})
    model = context_mixing.Model(vocabulary, np.full(18, 9), np.arange(18) % 8, 3000, 0)
    fit = context_mixing.Fit(model.weights)
    total = model.seen((t.encode() for _, t in docs), fit)
    table, weights = context_mixing._learnt(spark.createDataFrame(docs, DOCS).coalesce(1), model)
    assert (table == context_mixing.quantised(*total)).all()
    assert np.allclose(weights, fit.weights, atol=2 / context_mixing.WHOLE) and (weights != model.weights).any()
    assert fit.uses.sum() * (context_mixing.CONTEXTS + 1) == total.sum()
    # five documents of 3,000 are of another kind
    kinds = [(i, "zoo yak xyz" if i % 600 == 0 else "abc bad cab") for i in range(3000)]
    groups = context_mixing._grouping(spark.createDataFrame(kinds, DOCS).selectExpr("*", "false AS held_out"))
    assert groups.class_of(b"zoo yak") != groups.class_of(b"abc bad") and len(groups.centres) == 2


def test_lexicon_finds_words_by_all_their_bytes():
    words = [b"a", b"a\0", b"\0", b"abcdefgh", b"abcdefghi", b"x" * 16, b"x" * 17, b"x" * 40, "é".encode()]
    words += [b"n%d" % k for k in range(500)]
    texts = [b"A a\0 \0 b\0 b", b"", b" \t\x0b", b" ".join(words + [b"abcdefg", b"x" * 18, b"n0\0", b"b"]) + b"\n"]
    for known in (words, []):
        number, size = context_mixing.Lexicon(known).numbers(texts)
        of, new, expected = {w: i for i, w in enumerate(known)}, {}, []
        for text in texts:
            for w in text.translate(LOWER).split():
                expected.append(of[w] if w in of else new.setdefault(w, len(known) + 1 + len(new)))
            expected.append(len(known))
        assert number.tolist() == expected and size.tolist() == [len(t.split()) + 1 for t in texts]
