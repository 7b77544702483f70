"""User patterns: Python's meaning in the engine's dialect, refusals, and failures kept to their files."""

import re

import pytest
from pyspark.sql import functions as F

from patchloom import analyze_diffs
from patchloom.functions.regex import PatternError, spark_pattern, to_engine

# pattern, sample lines: Spark must find what Python finds, and the same first group
TABLE = [
    (r"def (?P<name>\w+)\((?P=name)?\)", ["def f()", "def g(g)", "def h(x)", "def ü(ü)"]),
    (r"^class (\w+):\Z", ["class A:", "class B: ", "class C:x"]),
    (r"(\d+) items", ["3 items", "٣ items", "x items"]),
    (r"(?<=let )(\w+)", ["let x = 1", "const y = 2"]),
    (r"\b(is)\b", ["this is it", "island", "is"]),
    (r"([[a]+)", ["[[a", "b"]),
    (r"x([]y]+)", ["x]]y", "xz"]),
    (r"(a{,2})b", ["aaab", "b"]),
    (r"(\w+)\s*{", ["fn main() {", "struct S{", "x"]),
    (r"([a-c&&b])", ["&", "b", "z"]),
]


@pytest.mark.parametrize("pattern,lines", TABLE)
def test_translation_keeps_pythons_meaning(spark, pattern, lines):
    engine = spark_pattern(to_engine(pattern))
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = df.select("line", F.col("line").rlike(engine).alias("hit"), F.regexp_extract("line", engine, 1).alias("g"))
    for row in got.collect():
        found = re.search(pattern, row.line)
        assert (row.hit, row.g) == (found is not None, (found.group(1) or "") if found else ""), row.line


@pytest.mark.parametrize("pattern", [r"(?a)\w+", r"\N{DIGIT ONE}", "(", r"(?(1)a|b)"])
def test_refusals_say_why(pattern):
    with pytest.raises(PatternError):
        to_engine(pattern)


def test_a_failing_pattern_marks_its_files_only(spark, diffs_of):
    diff = ("diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -0,0 +1 @@\n+def f():\n"
            "diff --git a/b.js b/b.js\n--- a/b.js\n+++ b/b.js\n@@ -0,0 +1 @@\n+function g() {\n")
    patterns = {"python": {"function": r"def (?P<name>\w+)"}, "javascript": {"function": r"(?a)function (\w+)"}}
    rows = {r.filename: r for r in analyze_diffs(diffs_of(diff), patterns=patterns).collect()}
    assert rows["a.py"].status == "ok" and [e.element_name for e in rows["a.py"].elements] == ["f"]
    assert rows["b.js"].status == "failed" and rows["b.js"].complexity_score == 0
