import json

import pytest
from pyspark.sql import functions as F

from patchloom import (
    analyze_files,
    apply_template,
    file_summaries,
    find_template,
    is_supported_format,
    list_templates,
    parse_files,
    render,
    render_by_column,
    render_diffs,
    render_parts,
    statistics,
    summarize,
    summarize_diffs,
    supported_formats,
    top_purposes,
)

ELEMENT = "struct<change_type:string,element_name:string,description:string,before:string,after:string>"
ANALYSIS = (
    "diff_id bigint, file_seq bigint, filename string, change_type string, old_filename string,"
    f" lines_added bigint, lines_removed bigint, elements array<{ELEMENT}>,"
    " purpose_inference string, impact_assessment string, complexity_score int"
)
SUMMARY = (
    "diff_id bigint, overview string, statistics struct<total_files:bigint,files_added:bigint,files_modified:bigint,"
    "files_deleted:bigint,total_lines_added:bigint,total_lines_removed:bigint>,"
    " file_summaries array<struct<filename:string,summary:string,key_changes:array<string>>>,"
    " key_changes array<string>, recommendations array<string>"
)


def change(diff_id, seq, name="f.py", kind="modified", old=None, added=0, removed=0, elements=(), purpose="Code modification",
           impact="Small-scale changes - low impact", score=0):
    elements = None if elements is None else [(t, n, "", None, None) for t, n in elements]
    return (diff_id, seq, name, kind, old, added, removed, elements, purpose, impact, score)


def analysis_of(spark, *changes):
    return spark.createDataFrame(list(changes), ANALYSIS)


def summary_of(spark, *changes):
    return {r.diff_id: r for r in summarize(analysis_of(spark, *changes)).collect()}


def test_worked_example(diffs_of):
    text = "diff --git a/m.py b/m.py\n@@ -1,2 +1,3 @@\n def a():\n+    print('x')\n     return 1"
    (row,) = summarize_diffs(diffs_of(text)).collect()
    assert row.overview == (
        "1 file changed. 1 modified. (+1 lines). Primary focus: Debugging or logging enhancement."
    )
    assert row.recommendations == ["Consider adding tests for the new functionality"]
    assert row.key_changes == [] and row.parsed_files == 1
    assert row.file_summaries[0].summary == (
        "Modified 'm.py' - (+1 lines) - Purpose: Debugging or logging enhancement"
    )


def test_descriptions(spark):
    many = [("function_added", "a"), ("class_added", "C"), ("function_added", "b"), ("function_removed", "c"),
            ("class_modified", "D"), ("class_modified", "E"), ("odd", "z")]
    rows = file_summaries(
        analysis_of(
            spark,
            change(1, 1, "n.py", "added", added=3, elements=many, purpose="Feature addition", score=7,
                   impact="Large-scale changes - High Impact"),
            change(1, 2, "g.py", "renamed", "o.py", removed=2, score=4),
            change(1, 3, "g.py", "renamed", None, added=1, removed=2, purpose=""),
            change(1, 4, "g.py", "deleted", elements=None, score=3),
            change(1, 5, "g.py", impact=None),
        )
    ).orderBy("file_seq").collect()
    assert [r.summary for r in rows] == [
        "Added new file 'n.py' - (+3 lines) - added 2 functions, removed function c; added class C, modified 2 classs"
        " - Purpose: Feature addition",
        "Renamed 'o.py' to 'g.py' - (-2 lines)",
        "Renamed 'None' to 'g.py' - (+1 lines, -2 lines)",
        "Deleted file 'g.py'",
        "Error generating summary for g.py",
    ]
    assert rows[0].key_changes == [
        "Added function 'a'", "Added class 'C'", "Added function 'b'", "Removed function 'c'", "Modified class 'D'",
        "Modified class 'E'", "High complexity change (score: 7/10)", "High impact change - review carefully",
    ]
    assert rows[1].key_changes == ["Medium complexity change (score: 4/10)"]
    assert rows[3].key_changes == rows[4].key_changes == []


def test_overview_and_ties(spark):
    rows = summary_of(
        spark,
        change(1, 1, purpose="B; A", kind="added", added=2),
        change(1, 2, purpose="A; C; D"),
        change(1, 3, purpose="D; C", kind="deleted", removed=3),
        change(2, 1, purpose="", kind="renamed"),
    )
    # A, C and D twice each: by first appearance.
    assert rows[1].overview == (
        "3 files changed. 1 added. 1 modified. 1 deleted. (+2, -3 lines). Primary focus: A, C, D."
    )
    assert rows[2].overview == "1 file changed."
    assert tuple(rows[2].statistics) == (1, 0, 0, 0, 0, 0)


def test_key_changes(spark):
    classes = [("class_added", "A"), ("class_removed", "B"), ("subclass_added", "C")]
    changes = [
        change(1, 1, "a", "added", added=100, removed=1, score=7),
        change(1, 2, "b", "deleted", score=6),
        change(1, 3, "c", elements=classes),
        change(1, 4, "d", "added", elements=classes[:2], added=100),
    ]
    changes += [change(2, i, f"n{i}", "added", score=9) for i in range(1, 4)]
    changes += [change(3, i, f"n{i}", "added", score=9) for i in range(1, 5)]
    changes += [change(4, i, f"n{i}", "deleted", score=7 if i > 2 else 0) for i in range(1, 12)]
    rows = summary_of(spark, *changes)
    assert rows[1].key_changes == [
        "High complexity change in a", "New file: a", "New file: d", "Deleted file: b", "Large change in a (101 lines)",
        "Multiple class changes in c",
    ]
    assert rows[2].key_changes == [f"High complexity change in n{i}" for i in (1, 2, 3)] + [f"New file: n{i}" for i in (1, 2, 3)]
    assert rows[3].key_changes == [f"High complexity change in n{i}" for i in (1, 2, 3, 4)] + ["Multiple new files added (4 files)"]
    assert rows[4].key_changes == [f"High complexity change in n{i}" for i in range(3, 12)] + ["Deleted file: n1"]


def test_recommendations(spark):
    tests, docs = "Consider adding tests for the new functionality", "Consider updating documentation for new features"
    rows = summary_of(
        spark,
        change(1, 1, "Spec.py"), change(1, 2, "a.py"), change(1, 3, "b.py"),
        change(2, 1, "Spec.py"), change(2, 2, "a.py"), change(2, 3, "b.py"), change(2, 4, "c.py"),
        change(3, 1, "test", purpose="Feature addition"),
        change(4, 1, "test", purpose="Feature addition"), change(4, 2, "test", purpose="Documentation update"),
        change(5, 1, "test", added=250, removed=250), change(6, 1, "test", added=251, removed=250),
        change(7, 1, "a", score=7, purpose="Feature addition", impact="Public API changes (1 elements)", added=501,
               elements=[("import_added", "x")]),
    )
    assert [rows[i].recommendations for i in range(1, 8)] == [
        [], [tests], [docs], [], [], ["Large-scale changes - consider breaking into smaller commits"],
        ["Review 1 high-complexity changes carefully", tests, docs, "API changes detected - ensure backward compatibility",
         "Large-scale changes - consider breaking into smaller commits",
         "Dependency changes detected - verify build and deployment"],
    ]


def test_fallbacks(spark, diffs_of):
    rows = summary_of(
        spark,
        change(1, 1, purpose=None),
        change(2, 1, score=None),
        change(3, 1, purpose="Documentation; Feature addition"), change(3, 2, purpose=None),
        change(4, 1, purpose="Documentation"), change(4, 2, purpose=None),
        (5, None, None, None, None, None, None, None, None, None, None),
    )
    for i in (1, 2, 4):
        assert rows[i].overview == "Error generating summary"
        assert rows[i].recommendations == ["Review failed - manual analysis recommended"]
        assert rows[i].file_summaries == [] and rows[i].statistics.total_files == 0
    assert rows[3].overview.startswith("2 files changed")
    assert rows[5].overview == "No changes detected"
    assert tuple(rows[5].statistics) == (0,) * 6 and rows[5].recommendations == []
    texts = ["", None, "diff --git a/ b/\n@@ -1 +1 @@\n+a"]
    empties = summarize_diffs(diffs_of(*texts)).orderBy("diff_id").collect()
    assert [(r.overview, r.parsed_files) for r in empties] == [("No changes detected", n) for n in (0, 0, 1)]


def test_composite_keys(spark):
    text = "diff --git a/x b/x\n@@ -1 +1 @@\n+a"
    df = spark.createDataFrame([("r1", 1, text), ("r2", 1, text + "\n+b")], "repo string, commit int, diff_text string")
    rows = summarize_diffs(df, keys=("repo", "commit")).orderBy("repo").collect()
    assert [(r.repo, r.commit, r.statistics.total_lines_added) for r in rows] == [("r1", 1, 1), ("r2", 1, 2)]


def test_one_change_set_holds_almost_all_files(spark):
    """Many chunks in one change set: same answer, whole, by both purpose counts and in parts."""
    n = 10000
    section = lambda i: f"diff --git a/f{i}.py b/f{i}.py\n" + (
        "new file mode 1\n" if i % 2 else "deleted file mode 1\n"
    ) + f"@@ -1 +1 @@\n+def f{i}():"
    big = "\n".join(section(i) for i in range(n))
    df = spark.createDataFrame([(1, big)] + [(i, section(i)) for i in range(2, 50)], "diff_id bigint, diff_text string")
    files = parse_files(df.repartition(8), keep_empty=True)
    analysis = analyze_files(files, keep_empty=True)
    rows = {r.diff_id: r for r in summarize(analysis, known_purposes=True).collect()}
    row = rows[1]
    assert row.statistics.total_files == n and len(rows) == 49
    assert [f.filename for f in row.file_summaries] == [f"f{i}.py" for i in range(n)]
    assert row.key_changes == [f"Multiple new files added ({n // 2} files)"] + [f"Deleted file: f{2 * i}.py" for i in range(9)]
    assert "Primary focus: Feature addition, File removal, New file creation." in row.overview
    headers = summarize(analysis, with_files=False)
    assert {r.diff_id: (r.overview, r.key_changes, r.recommendations) for r in headers.collect()} == {
        i: (r.overview, r.key_changes, r.recommendations) for i, r in rows.items()
    }
    top = top_purposes(analysis).where("diff_id = 1").orderBy("rank").collect()
    assert [(r.purpose, r.n_files) for r in top] == [("Feature addition", n), ("File removal", n // 2), ("New file creation", n // 2)]
    for name in ("plain", "md"):
        parts = render_parts(headers, file_summaries(analysis), name).where("diff_id = 1").orderBy("part").collect()
        whole = render(summarize(analysis, known_purposes=True), name).where("diff_id = 1").first().rendered
        assert "\n".join(p.text for p in parts) == whole
    counted = statistics(files).where("diff_id = 1").first()
    assert (counted.total_files, counted.files_added, counted.files_deleted) == (n, n // 2, n // 2)


def sample(spark):
    rows = [
        (1, "Über “x” \\ \x1b\t", (3, 1, 0, 2, 10, 0), [("a.py", "sum", ["k1", "k2"]), ("b", "s", [])], ["c1", "c2"], ["r1"]),
        (2, "No changes detected", (0,) * 6, [], [], []),
    ]
    return spark.createDataFrame(rows, SUMMARY)


def test_json(spark):
    rows = {r.diff_id: r.rendered for r in render(sample(spark), "JSON").collect()}
    names = ["total_files", "files_added", "files_modified", "files_deleted", "total_lines_added", "total_lines_removed"]
    first = {
        "overview": "Über “x” \\ \x1b\t",
        "statistics": dict(zip(names, (3, 1, 0, 2, 10, 0))),
        "file_summaries": [
            {"filename": "a.py", "summary": "sum", "key_changes": ["k1", "k2"]},
            {"filename": "b", "summary": "s", "key_changes": []},
        ],
        "key_changes": ["c1", "c2"],
        "recommendations": ["r1"],
    }
    assert rows[1] == json.dumps(first, indent=2, ensure_ascii=False)
    empty = {"overview": "No changes detected", "statistics": dict.fromkeys(names, 0), "file_summaries": [], "key_changes": [],
             "recommendations": []}
    assert rows[2] == json.dumps(empty, indent=2, ensure_ascii=False)
    nulls = spark.createDataFrame([(1, None, (0,) * 6, [("a", None, [])], [], [])], SUMMARY)
    parsed = json.loads(render(nulls, "json").first().rendered)
    assert parsed["overview"] is None and parsed["file_summaries"][0]["summary"] is None


def test_markdown_and_plain(spark):
    df = sample(spark).withColumn("overview", F.lit("O"))
    assert render(df, "md").where("diff_id = 1").first().rendered == (
        "# Code Change Summary\n\n## Overview\nO\n\n## Statistics\n- **Total files changed:** 3\n- **Files added:** 1\n"
        "- **Files deleted:** 2\n- **Lines added:** +10\n- **Lines removed:** -0\n\n## Key Changes\n- c1\n- c2\n\n"
        "## File Details\n### a.py\nsum\n\n**Key changes:**\n- k1\n- k2\n\n### b\ns\n\n## Recommendations\n- r1\n"
    )
    assert render(df).where("diff_id = 1").first().rendered == (
        "CODE CHANGE SUMMARY\n" + "=" * 50 + "\n\nOVERVIEW:\nO\n\nSTATISTICS:\n  Total files changed: 3\n  Files added: 1\n"
        "  Files deleted: 2\n  Lines added: +10\n  Lines removed: -0\n\nKEY CHANGES:\n  1. c1\n  2. c2\n\nFILE DETAILS:\n"
        + "-" * 30 + "\nFile: a.py\nSummary: sum\nKey changes:\n  - k1\n  - k2\n\nFile: b\nSummary: s\n\n"
        "RECOMMENDATIONS:\n  1. r1\n"
    )
    assert render(df, "text").where("diff_id = 2").first().rendered == (
        "CODE CHANGE SUMMARY\n" + "=" * 50 + "\n\nOVERVIEW:\nO\n\nSTATISTICS:\n  Total files changed: 0\n"
        "  Lines added: +0\n  Lines removed: -0\n"
    )


def test_templates(spark):
    df = sample(spark)
    text = apply_template(df, "{{x}} {total_files} {lines_added}\n{key_changes}\n{recommendations}\n{file_summaries}")
    assert [r.rendered for r in text.orderBy("diff_id").collect()] == [
        "{x} 3 10\n- c1\n- c2\n- r1\n- a.py: sum\n  - k1\n  - k2\n- b: s",
        "{x} 0 0\n\n\nNo file changes",
    ]
    for bad in ("", "{nothing}", "{", "}", "{}", "{0}", "{total_files:>5}", "{overview!r}", "{overview.x}"):
        with pytest.raises(ValueError):
            apply_template(df, bad)
    named = {"short": "S {total_files}"}
    rendered = lambda **options: render(df, templates=named, **options).where("diff_id = 1").first().rendered
    assert rendered(template="T", template_name="short", format_name="json") == "T"
    assert rendered(template_name="short", format_name="json") == "S 3"
    assert list_templates(named) == named and find_template("short", named) == "S {total_files}"
    with pytest.raises(ValueError, match="not found"):
        render(df, template_name="long", templates=named)


def test_formats(spark):
    assert supported_formats() == ["json", "markdown", "md", "plain", "text"]
    assert is_supported_format("MarkDown") and not is_supported_format("xml")
    for bad in ("", "xml"):
        with pytest.raises(ValueError):
            render(sample(spark), bad)
    by_row = sample(spark).withColumn("format", F.when(F.col("diff_id") == 1, "MD").otherwise("Json"))
    texts = [r.rendered[:1] for r in render_by_column(by_row).orderBy("diff_id").collect()]
    assert texts == ["#", "{"]
    with pytest.raises(Exception, match="Unsupported format type: xml"):
        render_by_column(by_row.withColumn("format", F.lit("XML"))).collect()


def test_null_text_in_plain_lists_is_kept_out_of_no_one_elses_row(spark, diffs_of):
    rows = render_diffs(diffs_of("", "diff --git a/x b/x")).orderBy("diff_id").collect()
    assert "No changes detected" in rows[0].rendered and "File: x" in rows[1].rendered
