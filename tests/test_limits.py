"""Long lines, null keys, user types and sinks that keep their keys."""

import time

from patchloom import analyze_diffs, render_diffs, summarize_diffs, write_reports
from patchloom.functions.text import strip
from patchloom.operators.analysis import analyze_files
from patchloom.operators.parse import parse_files
from patchloom.operators.summary import summarize

DIFF = "diff --git a/f.py b/f.py\n@@ -1 +1,2 @@\n+def run():\n+    pass\n"


def test_strip_is_linear(spark):
    text = "　\x85\x1c a" + " " * 1_000_000 + "b \t\r"
    df = spark.createDataFrame([(text,)], "t string").select(strip("t").alias("t"))
    df.first()
    started = time.time()
    assert df.first().t == "a" + " " * 1_000_000 + "b"
    assert time.time() - started < 3


def test_user_types_count_by_substring(spark):
    patterns = {"python": {"asyncfunction": r"^\s*def\s+(\w+)", "data class": r"^\s*pass()"}}
    diffs = spark.createDataFrame([(1, DIFF)], "diff_id bigint, diff_text string")
    row = analyze_diffs(diffs, patterns=patterns).first()
    assert row.elements[0].change_type == "asyncfunction_added"
    assert "Feature addition" in row.purpose_inference
    assert summarize_diffs(diffs, patterns=patterns).count() == 1


def test_null_key_keeps_its_focus(spark):
    diffs = spark.createDataFrame([(None, DIFF), (2, DIFF)], "diff_id bigint, diff_text string")
    analysis = analyze_files(parse_files(diffs))
    closed = {r.diff_id: r.overview for r in summarize(analysis, known_purposes=True).collect()}
    open_ = {r.diff_id: r.overview for r in summarize(analysis).collect()}
    assert open_ == closed and "focus" in open_[None]


def test_many_modified_names(spark):
    names = [f"name{i}" for i in range(200)]
    body = "".join(f"-def {n}(a):\n+def {n}(b):\n" for n in names)
    diffs = spark.createDataFrame([(1, f"diff --git a/f.py b/f.py\n@@ -1 +1 @@\n{body}")], "diff_id bigint, diff_text string")
    elements = analyze_diffs(diffs).first().elements
    assert [e.element_name for e in elements if e.change_type == "function_modified"] == names
    assert {e.change_type for e in elements} == {"function_modified"}


def test_reports_keep_their_keys(spark, tmp_path):
    diffs = spark.createDataFrame([(1, DIFF), (2, ""), (3, DIFF)], "diff_id bigint, diff_text string")
    rendered = render_diffs(diffs)
    for name in ("parquet", "json"):
        write_reports(rendered, str(tmp_path / name), format_name=name)
        back = spark.read.format(name).load(str(tmp_path / name)).select("diff_id", "rendered")
        assert sorted(back.collect()) == sorted(rendered.select("diff_id", "rendered").collect())
