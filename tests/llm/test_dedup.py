"""Line dedup, decontamination, SimHash and the pipeline against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from compare import checking_engine, compare

import corpus_pipeline
from patchloom.llm import catalog, decontaminate, line_dedup, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_queries_with_sql(spark, name):
    same, note = compare(spark, checking_engine(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert same, note


def test_lines_on_many_sites_stay_once(spark):
    rows = [(i, f"own {i}\n share d \n\n{'rare' if i < 3 else 'x'}{i % 2}\n", f"s{i}" if i else None) for i in range(12)]
    rows += [(99, None, "s1"), (98, "", "s2"), (3, rows[3][1], "s3"), (None, " share d", "s5")]
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", pos int")
    out = line_dedup.remove_boilerplate(df, min_sites=10, counts=True)
    assert out.columns == ["doc_id", "text", "source", "pos", "n_lines", "n_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert got[0] == [("own 0\n share d \n\nrare0\n", 0)]
    assert got[5] == [("own 5\n\nx1\n", 1)]
    assert got[3] == [("own 3\n\nx1\n", 1)] * 2
    assert got[99] == [(None, 0)] and got[98] == [("", 0)] and got[None] == [("", 1)]
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def hits_by_hand(words, items):
    hit, found = set(), set()
    for item_id, item in items:
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item_id)
    return hit, found


def test_automaton_matches_brute_force():
    random = np.random.default_rng(0)
    for turn in range(150):
        words = [bytes([97 + x]) for x in random.integers(0, 2 + turn % 3, 400)]
        items = [[bytes([97 + x]) for x in random.integers(0, 2 + turn % 3, random.integers(0, 30))] for _ in range(6)]
        items.append(words[50:75])
        items.append(words[50:54])
        spans, found = decontaminate.Automaton().fill(items).find(words)
        want, ids = hits_by_hand(words, list(enumerate(items)))
        assert {k for a, b in spans for k in range(a, b)} == want
        assert found == ids


def test_blocks_of_the_benchmark_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "!?")], "doc_id bigint, text string"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.unionAll(spark.createDataFrame([(None, "zz"), (7, None), (8, "")], bench.schema))
    one = decontaminate.with_hits(docs, bench, "found").select("doc_id", "found").collect()
    many = decontaminate.with_hits(docs, bench, "found", block_words=300).select("doc_id", "found").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))
    assert any(r.found.spans for r in one)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 OR n_items > 0").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_spans_are_cut(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {passage.upper()}! after", 5), (2, "clean", 6)], "doc_id bigint, text string, found int")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    cut = {r.doc_id: (r.text, r.found) for r in decontaminate.decontaminate(docs, bench, cut_spans=True).collect()}
    assert cut == {1: ("Before, ! after", 5), 2: ("clean", 6)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "A b c d e f g\x0bh", "x " * 500):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def roots_by_hand(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_links_connect_what_is_near(spark):
    random = np.random.default_rng(5)
    values = set()
    for _ in range(12):
        value = int(random.integers(0, 2**63)) * 2 + 1
        for _ in range(12):
            values.add(value)
            for bit in random.choice(64, random.integers(1, 5), replace=False):
                value ^= 1 << int(bit)
    values |= {0, 1, 7, 15}
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "simhash bigint").repartition(3))
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want, classes = roots_by_hand(sorted(values)), {}
    for v in values:
        classes.setdefault(want[v], set()).add(found.get(v, v))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.limit(0)).count() == 0


def test_near_duplicate_rows(spark):
    rows = [(5, "a b c", 1), (3, "A b  c", 1), (3, "A b  c", 1), (None, "a b c", 1), (8, None, 1), (9, "", 1), (10, "d e f", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, root int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (8, 8), (9, 8), (10, 10)], key=str)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [3, 8, 10]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    clash = df.withColumn("near_key", F.lit(1)).withColumn("key", F.lit(2)).withColumn("simhash", F.lit(3))
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8, 10]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        assert len({r.doc_id for r in after}) == len(after) and {r.doc_id for r in after} <= set(before)
        assert docs.columns == (columns if at < 4 else [*columns, "copies"])
        if name == "line_dedup":
            assert len(after) == len(before)
        elif name == "near_dedup":
            prints = roots_by_hand(sorted({slow_fingerprint(r.text) for r in before.values()}))
            least = {}
            for r in before.values():
                root = prints[slow_fingerprint(r.text)]
                least[root] = min(least.get(root, r.doc_id), r.doc_id)
            assert {r.doc_id for r in after} == set(least.values())
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            items = [(b.item_id, decontaminate.words_of(b.text)) for b in bench]
            for r in before.values():
                words = decontaminate.words_of(r.text)
                n = len(hits_by_hand(words, items)[0])
                assert (n > 0 and 20 * n >= len(words)) == (r.doc_id not in {a.doc_id for a in after})
    assert all(r.copies >= 1 for r in after)
