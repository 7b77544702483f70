from pyspark.sql import Window
from pyspark.sql import functions as F

from patchloom import (
    extract_hunks,
    extract_lines,
    is_blank,
    looks_like_diff,
    parse_files,
    parse_hunks,
    parse_lines,
)
from workload.corpus import diffs as corpus_diffs

SF = "/root/testdata/sf0.001"

MODIFIED = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -1,3 +1,4 @@
 def hi():
+    print("x")
     return 1

"""
ADDED = """diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,3 @@
+def n():
+    return 1
+
"""
DELETED = """diff --git a/o.py b/o.py
deleted file mode 100644
@@ -1,3 +0,0 @@
-def o():
-    return 1
-
"""
RENAMED = """diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
"""


def files(df):
    rows = parse_files(df).orderBy("diff_id", "file_seq").collect()
    return [
        (r.diff_id, r.file_seq, r.filename, r.change_type, r.old_filename, r.lines_added, r.lines_removed)
        for r in rows
    ]


def test_kinds_of_change(diffs_of):
    assert files(diffs_of(MODIFIED, ADDED, DELETED, RENAMED, ADDED + DELETED)) == [
        (1, 1, "app.py", "modified", None, 1, 0),
        (2, 1, "n.py", "added", None, 3, 0),
        (3, 1, "o.py", "deleted", None, 0, 3),
        (4, 1, "new.py", "renamed", "old.py", 0, 0),
        (5, 1, "n.py", "added", None, 3, 0),
        (5, 2, "o.py", "deleted", None, 0, 3),
    ]


def test_headers(diffs_of):
    cases = [
        "diff --git whatever\n@@ -1 +1 @@\n+a",
        "diff --git a/ b/\n@@ -1 +1 @@\n+a",
        "diff --git a/x b/y b/z",
        "diff --git a/x b/y\nnew file mode 1\nrename from q\nrename to r",
        "diff --git a/x b/y\nrename from q\nnew file mode 1\nrename from \nrename to t\nrename to u\ndeleted file mode",
        "diff --git a/x.py b/x.py\r\n@@ -1 +1 @@\r\n+a\r",
        "diff --git a/x b/x\n@@ -1 +1 @@\n+a\nnew file mode 1\nrename from n",
        "diff --git a/x b/x\nrename fromage\nrename to",
    ]
    assert files(diffs_of(*cases)) == [
        (1, 1, "unknown", "modified", None, 1, 0),
        (2, 1, "", "modified", None, 1, 0),
        (3, 1, "y b/z", "renamed", "x", 0, 0),
        (4, 1, "r", "renamed", "q", 0, 0),
        (5, 1, "u", "deleted", "", 0, 0),
        (6, 1, "x.py\r", "renamed", "x.py", 1, 0),
        (7, 1, "x", "modified", None, 1, 0),
        (8, 1, "x", "modified", None, 0, 0),
    ]


def test_malformed_hunks_and_stray_lines(diffs_of):
    text = (
        "Subject\n@@ -1 +1 @@\n+stray\n"
        "diff --git a/x b/x\n@@ bad @@\n+dropped\n-dropped\n@@ -5 +6,2 @@ f()  \n+kept\n\\ No newline\n@@@\n+dropped"
    )
    df = diffs_of(text)
    assert files(df) == [(1, 1, "x", "modified", None, 1, 0)]
    hunks = [tuple(r) for r in parse_hunks(df).collect()]
    assert hunks == [(1, 1, 1, 5, 1, 6, 2, "f()")]


def test_lines_and_numbers(diffs_of):
    text = "diff --git a/x b/x\n@@ -10,4 +20,4 @@\n a\n+b\n-c\n\nraw\n+d\n-e\n"
    rows = parse_lines(diffs_of(text)).orderBy("line_seq").collect()
    assert [(r.line_seq, r.line_type, r.content, r.line_number) for r in rows] == [
        (1, " ", "a", 10),
        (2, "+", "b", 21),
        (3, "-", "c", 11),
        (4, " ", "", 12),
        (5, " ", "raw", 13),
        (6, "+", "d", 24),
        (7, "-", "e", 14),
        (8, " ", "", 15),
    ]


def test_empty_input_gives_no_files_but_is_kept_on_request(diffs_of):
    df = diffs_of("", "  \n \n", None, "just text", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a", MODIFIED)
    assert [r[0] for r in files(df)] == [6]
    kept = parse_files(df, keep_empty=True).groupBy("diff_id").agg(F.count("file_seq").alias("n"))
    assert sorted((r.diff_id, r.n) for r in kept.collect()) == [(i, 0) for i in range(1, 6)] + [(6, 1)]
    flags = df.select("diff_id", is_blank(F.col("diff_text")), looks_like_diff(F.col("diff_text")))
    assert [tuple(r)[1:] for r in flags.orderBy("diff_id").collect()] == [
        (True, False),
        (True, False),
        (True, False),
        (False, False),
        (False, True),
        (False, True),
    ]


def test_fragments(spark):
    text = "@@ -1,3 +1,4 @@\n a\n+b\n c\n\n@@ -10,2 +11,3 @@\n d\n+e\n f\n"
    cut = "x\n@@ -1 +1 @@\n+a\ndiff --git a/x b/x\n+not in a hunk\n@@ -3 +3 @@\n-b"
    df = spark.createDataFrame([(1, text), (2, cut), (3, " ")], "fragment_id bigint, text string")
    hunks = extract_hunks(df).orderBy("fragment_id", "hunk_seq").collect()
    assert [(r.fragment_id, r.hunk_seq, r.old_start, r.new_start) for r in hunks] == [
        (1, 1, 1, 1),
        (1, 2, 10, 11),
        (2, 1, 1, 1),
        (2, 2, 3, 3),
    ]
    counts = extract_lines(df).groupBy("fragment_id", "hunk_seq").count().collect()
    assert sorted(tuple(r) for r in counts) == [(1, 1, 4), (1, 2, 4), (2, 1, 1), (2, 2, 1)]


def windowed_lines(diffs):
    """The same parse by running counts over exploded lines."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff_text", "\n")).alias("pos", "line"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = lambda mark: F.when(F.col("line").startswith(mark), 1).otherwise(0)
    w = Window.partitionBy("diff_id").orderBy("pos")
    lines = lines.withColumn("file_seq", F.sum(starts("diff --git")).over(upto(w))).where("file_seq > 0")
    w = Window.partitionBy("diff_id", "file_seq").orderBy("pos")
    lines = lines.withColumn("raw", F.sum(starts("@@")).over(upto(w))).where("raw > 0")
    hunk = r"^@@ -[0-9]+(,[0-9]+)? \+[0-9]+(,[0-9]+)? @@"
    heads = lines.where(F.col("line").startswith("@@") & F.col("line").rlike(hunk)).select("diff_id", "file_seq", "raw")
    body = lines.where(~F.col("line").startswith("@@")).join(heads, ["diff_id", "file_seq", "raw"])
    kind = F.when(F.left("line", F.lit(1)).isin("+", "-"), F.left("line", F.lit(1))).otherwise(" ")
    return body.select("diff_id", "file_seq", kind.alias("line_type"))


def test_both_parses_agree(spark):
    df = corpus_diffs(spark, SF)
    count = lambda x: x.groupBy("diff_id", "file_seq", "line_type").count()
    ours = {tuple(r) for r in count(parse_lines(df)).collect()}
    assert ours == {tuple(r) for r in count(windowed_lines(df)).collect()}
    assert len(ours) > 300


def test_result_does_not_depend_on_partitions(spark):
    df = corpus_diffs(spark, SF)
    one = parse_lines(df.repartition(1)).collect()
    many = parse_lines(df.repartition(17)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
