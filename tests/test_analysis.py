import re

import pytest
from pyspark.sql import functions as F

from patchloom import (
    analyze_diffs,
    analyze_files,
    code_elements,
    detect_language,
    element_rows,
    split_sides,
)
from patchloom.fixed_values import ELEMENT_PATTERNS, KNOWN_PURPOSES, LANGUAGE_BY_EXTENSION
from patchloom.functions.regex import spark_pattern

LINES = "array<struct<line_type:string,content:string>>"
FILES = (
    "diff_id bigint, file_seq bigint, filename string, change_type string, old_filename string,"
    f" lines_added bigint, lines_removed bigint, lines {LINES}"
)


def analysed(spark, *rows, **options):
    """Rows are (filename, kind, signed lines[, added, removed])."""
    data = []
    for i, (name, kind, lines, *counts) in enumerate(rows, 1):
        added, removed = counts or (0, 0)
        data.append((i, 1, name, kind, None, added, removed, [(x[0], x[1:]) for x in lines]))
    files = split_sides(spark.createDataFrame(data, FILES)).drop("lines")
    return analyze_files(files, **options).orderBy("diff_id").collect()


def kinds(row):
    return [(e.change_type, e.element_name) for e in row.elements]


def test_languages(spark):
    names = {
        "main.py": "python", "a/b.test.JS": "javascript", "x.tsx": "typescript", "Makefile": "makefile",
        "src/Makefile": "unknown", "DOCKERFILE": "dockerfile", "ReadMe.xyz": "markdown", "docs/README": "unknown",
        "docs/README.txt": "unknown", "package.json": "json", ".gitignore": "config", ".env": "config",
        "a.b/c": "unknown", "noext": "unknown", "x.": "unknown", "s.R": "r", "": "unknown", "файл.py": "python",
    }
    names |= {"f" + extension: language for extension, language in LANGUAGE_BY_EXTENSION.items()}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.l for r in df.select("n", detect_language(F.col("n")).alias("l")).collect()}
    assert got == names


def test_code_elements(spark):
    code = [
        (1, "python", "import os\n\nclass A(B):\n    def f(self, x):\n        y = 1\n@deco\nfrom a.b import c, d\n"),
        (2, "javascript", "function f(a) {\nconst g = (x) => x;\nconst h=function() {}\nlet v = 3;\nimport x from 'y'"),
        (3, "cobol", "def f():"),
        (4, "python", "def функция(а):\n  x　= 1"),
        (5, "rust", "impl<T> A for B {\npub fn f(\nuse a::{b, c};"),
        (6, "python", None),
    ]
    df = spark.createDataFrame(code, "code_id bigint, language string, code string")
    rows = code_elements(df).orderBy("code_id", "type_ord", "line").collect()
    got = [(r.code_id, r.element_type, r.name, r.line, r.parameters) for r in rows]
    assert got == [
        (1, "function", "f", 4, "self, x"),
        (1, "class", "A", 3, None),
        (1, "import", "os", 1, None),
        (1, "import", "c, d", 7, None),
        (1, "variable", "y", 5, None),
        (1, "decorator", "deco", 6, None),
        (2, "function", "f", 1, ""),
        (2, "function", "g", 2, "g"),
        (2, "function", "h", 3, "h"),
        (2, "import", "anonymous", 5, None),
        (2, "variable", "g", 2, None),
        (2, "variable", "v", 4, None),
        (4, "function", "функция", 1, "а"),
        (4, "variable", "x", 2, None),
        (5, "function", "f", 2, None),
        (5, "impl", "A", 1, None),
        (5, "use", "a::{b, c}", 3, None),
    ]
    assert rows[0].content == "def f(self, x):"


SAMPLES = [
    "def f(a, b):", "  def _g ():", "def f(a", "class A:", "class A(B, C):", "class A", "import os, sys  # x",
    "from a.b import (c)", "x = 1", "x == 1", " @wraps(f)", "function f()", "const f = (a) => a", "let f=function",
    "const a = 1", "const a =", "const a = ;", "var a=(1)", "import {a} from 'b'", "import a from \"b\"", "import 'x'",
    "f(a) {", "if (x) {", "export class A", "export interface B {", "type T = {", "let f: (a) => void",
    "public class A {", "private static int f(", "import a.b.C;", "int x;", "private int x = 1;", "func f(a int) {",
    "func (r *R) f() {", "type S struct {", "type I interface {", "import \"fmt\"", "import `x`", "x := 1", "var y = 2",
    "pub fn f(", "fn g<T>(", "pub struct S;", "enum E {", "pub trait T {", "impl<T> A for B", "impl A", "use a::b;",
    "use a::{b, c};", "\tx = 'é'", "дом = 1", "", "   ", "// class A", "x\r", "const a = (x)\r=> x",
]


def test_patterns_mean_the_same_on_a_line_and_in_a_block(spark):
    """Every pattern on every sample: Python's own engine on the original text is the yardstick."""
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, line string")
    checks = [(l, t, p) for l, by_type in ELEMENT_PATTERNS.items() for t, p in by_type.items()]
    columns = [F.col("line").rlike(spark_pattern(p)).alias(f"{l}_{t}") for l, t, p in checks]
    for row in df.select("line", *columns).collect():
        for language, element_type, pattern in checks:
            expected = re.match(pattern, row.line) is not None
            assert row[f"{language}_{element_type}"] == expected, (row.line, language, element_type)
    rows = analysed(spark, *[("f." + e, "modified", ["+" + s for s in SAMPLES]) for e in ("py", "js", "ts", "java", "go", "rs")])
    for row in rows:
        expected = []
        for element_type, pattern in ELEMENT_PATTERNS[row.language].items():
            for line in SAMPLES:
                match = re.match(pattern, line)
                if match:
                    name = next((g for g in match.groups() if g), "anonymous")
                    expected.append((f"{element_type}_added", name, line.strip()))
        assert [(e.change_type, e.element_name, e.after) for e in row.elements] == expected


def test_added_removed_modified(spark):
    rows = analysed(
        spark,
        ("a.py", "modified", ["-def f():", "-def g():", "+def f():", "+def h():", "+class C:", "-x = 1", "+x = 2", " def k():"]),
        ("a.js", "modified", ["-const f = () => 1", "+const f = () => 2"]),
        ("a.js", "modified", ["-function f() {", "+function f() {", "+const f = () => 2"]),
        ("a.xyz", "modified", ["+def f():"]),
        ("a.sql", "modified", ["+def f():"]),
        ("a.py", "modified", ["+def b():", "+def a():", "-def a():", "-def b():"]),
    )
    assert kinds(rows[0]) == [
        ("function_added", "h"), ("class_added", "C"), ("function_removed", "g"),
        ("function_modified", "f"), ("variable_modified", "x"),
    ]
    assert rows[0].elements[0].description == "Added function 'h'"
    assert (rows[0].elements[2].before, rows[0].elements[2].after) == ("def g():", None)
    # A name caught by a second group is never matched up, except as a variable.
    assert kinds(rows[1]) == [("function_added", "f"), ("function_removed", "f"), ("variable_modified", "f")]
    # ... but it is dropped when the first group matches up under the same name.
    assert kinds(rows[2]) == [("variable_added", "f"), ("function_modified", "f")]
    assert kinds(rows[3]) == kinds(rows[4]) == []
    assert kinds(rows[5]) == [("function_modified", "b"), ("function_modified", "a")]


def test_very_many_modified_names(spark):
    n = 3000
    lines = [f"-def f{i}():" for i in range(n)] + [f"+def f{i}():" for i in range(0, n, 2)] + ["+def new():"]
    (row,) = analysed(spark, ("a.py", "modified", lines))
    got = kinds(row)
    assert got[0] == ("function_added", "new")
    assert [x for x in got if x[0] == "function_removed"] == [("function_removed", f"f{i}") for i in range(1, n, 2)]
    assert [x for x in got if x[0] == "function_modified"] == [("function_modified", f"f{i}") for i in range(0, n, 2)]


def test_imports_without_a_name(spark):
    rows = [
        ("main.go", "modified", ["+import \"fmt\""]),
        ("a.js", "modified", ["-import {a} from 'b'", "+function f() {"]),
        ("a.py", "modified", ["+import os"]),
    ]
    plain, compat = analysed(spark, *rows), analysed(spark, *rows, compat=True)
    assert kinds(plain[0]) == [("import_added", "anonymous")]
    assert "Dependency addition" in plain[0].purpose_inference and plain[0].status == "ok"
    for row in compat[:2]:
        assert row.elements == [] and row.complexity_score == 0 and row.status == "failed"
        assert row.purpose_inference == "Analysis failed"
        assert row.impact_assessment == "Unable to assess impact"
    assert compat[2] == plain[2]


def test_purposes(spark):
    cases = [
        (("n.txt", "added", []), "New file creation"),
        (("n.txt", "deleted", []), "File removal"),
        (("n.txt", "renamed", []), "File reorganization"),
        (("n.txt", "modified", []), "Code modification"),
        (("a.py", "modified", ["-def f():", "+def g():"]), "Code modification"),
        (("a.py", "modified", ["-def f():"]), "Code cleanup or deprecation"),
        (("a.py", "modified", ["-def f():", "+def f():"]), "Bug fix or enhancement"),
        (("a.py", "modified", ["-class A:", "+class A:"]), "Class enhancement"),
        (("a.py", "modified", ["-class A:"]), "Architecture refactoring"),
        (("a.py", "modified", ["-import os"]), "Dependency cleanup"),
        (("a.c", "modified", ["+LATEST", "-latest"]), "Test coverage improvement"),
        (("a.c", "modified", ["+prologue", "+entry"]), "Debugging or logging enhancement; Error handling improvement"),
        (("a.c", "modified", ["+Todo", "-FIXME"]), "Technical debt or temporary fix; Technical debt resolution"),
        (("docs/readme", "modified", ["+''' x"]), "Documentation update; Documentation improvement"),
        (("readme.py", "modified", ["+x"]), "Documentation update"),
        (("src/readme.py", "modified", ["+x"]), "Code modification"),
        (
            ("a.py", "added", ["+def f():", "+class A:", "+import os", "+# log"]),
            "New file creation; Feature addition; New component or module; Dependency addition; "
            "Debugging or logging enhancement; Documentation improvement",
        ),
    ]
    rows = analysed(spark, *[case for case, _ in cases])
    assert [r.purpose_inference for r in rows] == [text for _, text in cases]
    assert {p for r in rows for p in r.purposes} <= set(KNOWN_PURPOSES)


def test_impacts(spark):
    small = "Small-scale changes - low impact"
    cases = [
        (("a.py", "modified", ["+def f():", "+def _g():"], 20, 0),
         f"{small}; Public API changes (1 elements) - may affect external code; "
         "Internal implementation changes (1 elements); Core application code - runtime impact"),
        (("a.test.py", "added", [], 21, 0), "New functionality introduced; Medium-scale changes - moderate impact; Core application code - runtime impact"),
        (("a.yml", "deleted", [], 50, 50), "Functionality removed - may break dependencies; Medium-scale changes - moderate impact; Configuration changes - may affect deployment"),
        (("a.md", "renamed", [], 50, 51), "Import paths may need updating; Large-scale changes - high impact; Documentation changes - no runtime impact"),
        (("a.PY", "modified", [], 0, 0), small),
        (("a.py", "modified", ["+class A:", "+import b"], 0, 0),
         f"{small}; Public API changes (2 elements) - may affect external code; Class structure changes - may affect inheritance; "
         "Dependency changes - may affect build process; Core application code - runtime impact"),
    ]
    rows = analysed(spark, *[case for case, _ in cases])
    assert [r.impact_assessment for r in rows] == [text for _, text in cases]


def test_scores(spark):
    by_lines = [(10, 0), (11, 1), (20, 1), (50, 1), (51, 2), (100, 2), (101, 3), (200, 3), (201, 4)]
    cases = [(("a.c", "modified", [], n, 0), points) for n, points in by_lines]
    cases += [
        (("a.java", "modified", [], 0, 0), 1),
        (("a.json", "modified", [], 11, 0), 0),
        (("a.json", "deleted", [], 0, 0), 2),
        (("a.c", "renamed", [], 0, 0), 1),
        (("a.py", "modified", ["+class A:"], 0, 0), 3),
        (("a.py", "modified", ["-class A:"], 0, 0), 1),
        (("a.py", "modified", ["+def f():", "-def f():"], 0, 0), 2),
        (("a.py", "deleted", ["+def f():", "-def f():", "+class A:", "-class A:", "+import b", "+x = 1"], 150, 60), 10),
        (("simple.py", "modified", ['+print("hello")'], 0, 0), 0),
    ]
    rows = analysed(spark, *[case for case, _ in cases])
    assert [r.complexity_score for r in rows] == [points for _, points in cases]


def test_nameless_files_are_left_out(diffs_of):
    text = "diff --git a/ b/\n@@ -1 +1 @@\n+a\ndiff --git a/x b/x\n@@ -1 +1 @@\n+a"
    rows = analyze_diffs(diffs_of(text)).collect()
    assert [(r.file_seq, r.filename) for r in rows] == [(2, "x")]


def test_user_patterns_and_element_rows(spark):
    patterns = {"sql": {"table": r"^\s*create\s+table\s+(\w+)"}}
    data = [(1, 1, "a.sql", "modified", None, 0, 0, [("+", " create table t (a int)"), ("-", "create table u")])]
    files = split_sides(spark.createDataFrame(data, FILES)).drop("lines")
    rows = element_rows(analyze_files(files, patterns=patterns)).orderBy("element_seq").collect()
    assert [(r.element_seq, r.change_type, r.element_name) for r in rows] == [(1, "table_added", "t"), (2, "table_removed", "u")]


def test_modified_types_with_blanks_and_colons(spark):
    patterns = {"sql": {"my table": r"^\s*create\s+table\s+(\w+)", "1:view": r"^\s*create\s+view\s+(\w+)"}}
    lines = [("-", "create table t"), ("+", "create table t"), ("-", "create view t"), ("+", "create view t"),
             ("+", "create view 9")]
    data = [(1, 1, "a.sql", "modified", None, 0, 0, lines)]
    files = split_sides(spark.createDataFrame(data, FILES)).drop("lines")
    rows = element_rows(analyze_files(files, patterns=patterns)).orderBy("element_seq").collect()
    assert [(r.change_type, r.element_name) for r in rows] == [
        ("1:view_added", "9"), ("my table_modified", "t"), ("1:view_modified", "t")]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan


@pytest.mark.parametrize("keep_empty", [False, True])
def test_analysis_never_shuffles_and_reads_two_columns(spark, tmp_path, keep_empty):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "diff --git a/x.py b/x.py", 5)], "diff_id bigint, diff_text string, other int").write.parquet(path)
    from patchloom import parse_files, parse_hunks, parse_lines

    diffs = spark.read.parquet(path)
    analysis = analyze_files(parse_files(diffs, keep_empty=keep_empty), keep_empty=keep_empty)
    for df in (analysis, parse_lines(diffs), parse_hunks(diffs), element_rows(analysis)):
        n, plan = exchanges(df.where("diff_id = 1"))
        assert n == 0
        assert "PushedFilters: [IsNotNull(diff_id), EqualTo(diff_id,1)]" in plan
        assert "ReadSchema: struct<diff_id:bigint,diff_text:string>" in plan
    # A filter on a derived column must not copy the analysis below it.
    _, plain = exchanges(analysis)
    _, filtered = exchanges(analysis.where("complexity_score > 3 AND purpose_inference <> ''"))
    assert filtered.count("regexp_extract_all") == plain.count("regexp_extract_all")
