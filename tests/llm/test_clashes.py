"""Operators keep a caller's columns whatever their names, and their own never clash."""

from pyspark.sql import functions as F

from patchloom.llm import decontaminate, line_dedup, mixing, near_copies, pii, simhash

NAMES = ["pii_found", "pii_moved", "pii_text", "pii_made", "near_key", "mix_key", "mix_copies", "line_dedup_gone",
         "line_dedup_doc", "line_dedup_lines", "found_key", "found_hash", "key", "node", "hash"]


def docs(spark):
    texts = ["Call Dr. Anna Kovacs at anna@example.com.\nshared line here\n", "shared line here\nown text one",
             "shared line here\nown text two", "one two three four five six seven eight nine ten eleven twelve",
             "one two three four five six seven eight nine ten eleven twelve", None, ""]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for at, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(at))
    return df


def test_clashing_names(spark):
    df = docs(spark)
    out = pii.with_surrogates(df)
    assert out.columns == [*df.columns, "n_entities"] and out.count() == df.count()
    assert out.where("pii_found = 0 AND near_key = 4").count() == df.count()
    cleaned = line_dedup.remove_boilerplate(df, min_sites=2, counts=True)
    assert cleaned.columns == [*df.columns, "n_lines", "n_removed"] and cleaned.count() == df.count()
    counted = line_dedup.remove_boilerplate(df.withColumn("n_lines", F.lit(-1)), min_sites=2, counts=True)
    assert counted.columns.count("n_lines") == 1 and counted.where("n_lines < 0").count() == 0
    assert near_copies.keep_one(df).columns == df.columns
    assert simhash.keep_one(df).columns == df.columns
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copies"] and mixed.where("mix_copies = 6").count() == mixed.count()
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "own text")],
                                  "item_id bigint, text string")
    hits = decontaminate.with_hits(df, bench, "found", block_words=3)
    assert hits.columns == [*df.columns, "found"] and hits.where("found_key = 10 AND found_hash = 11").count() == df.count()
    # "own text" is an item of fewer than 13 words, so one window: 2 of 5 words of documents 1 and 2 are hit
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [0, 5, 6]
