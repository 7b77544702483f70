"""The corpus reaches every rule: no branch is without rows."""

import pytest
from pyspark.sql import functions as F

from patchloom import fixed_values as fixed
from patchloom.plans.reports import analyze_diffs, summarize_diffs
from workload.catalog import BLANKED
from workload.corpus import diffs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def files(spark):
    rows = analyze_diffs(diffs(spark, SF)).select(
        "diff_id",
        "file_seq",
        "filename",
        "language",
        "change_type",
        "complexity_score",
        "purpose_inference",
        "impact_assessment",
        F.expr("lines_added + lines_removed AS n"),
        F.expr("array_distinct(transform(elements, e -> e.change_type)) AS types"),
        F.expr("size(filter(elements, e -> endswith(e.change_type, '_modified'))) AS n_modified"),
        F.expr("size(filter(elements, e -> contains(e.change_type, 'class'))) AS n_class"),
        *[F.expr(f"{condition} AS no_{name}") for name, condition in BLANKED.items()],
    )
    return rows.toPandas()


@pytest.fixture(scope="module")
def reports(spark):
    rows = summarize_diffs(diffs(spark, SF), with_files=False)
    return rows.select("overview", "key_changes", "recommendations", "statistics.*").toPandas()


def test_names_and_languages(files):
    found = set(files["filename"])
    for extension in fixed.LANGUAGE_BY_EXTENSION:
        assert any(name.endswith(extension) for name in found), extension
    assert set(fixed.LANGUAGE_BY_NAME) <= {name.lower() for name in found}
    assert set(files["language"]) >= set(fixed.LANGUAGE_BY_EXTENSION.values()) | {fixed.UNKNOWN}
    for endings, text in fixed.IMPACT_BY_SUFFIX:
        assert files["impact_assessment"].str.contains(text, regex=False).any(), text
        assert any(name.endswith(endings) for name in found)


def test_sizes(files):
    for limit in (10, 50, 100, 200, 500):
        assert (files["n"] > limit).any() and (files["n"] <= limit).any()
    assert (files["n_modified"] > 64).any()
    assert (files["n_class"] > fixed.CLASS_CHANGES_OVER).any()
    assert {"decorator_added", "trait_added", "impl_added", "enum_removed"} <= set(files["types"].explode())
    assert files["complexity_score"].max() == fixed.SCORE_CAP and files["complexity_score"].min() <= 1


def test_change_sets(reports):
    assert (reports["files_added"] > fixed.NEW_FILES_LISTED).any()
    assert (reports["total_files"] >= 35).any() and (reports["total_files"] == 1).any()
    assert (reports["key_changes"].map(len) == fixed.MAX_KEY_CHANGES).any()
    assert (reports["total_lines_added"] + reports["total_lines_removed"] > fixed.LARGE_CHANGE_SET_OVER).any()
    notes = "\n".join(reports["key_changes"].explode().dropna())
    starts = ["High complexity", "Multiple new files", "New file", "Deleted file", "Large change", "Multiple class"]
    for start in starts:
        assert start in notes, start
    advice = "\n".join(reports["recommendations"].explode().dropna())
    for text in (fixed.ADVICE_TESTS, fixed.ADVICE_DOCS, fixed.ADVICE_API, fixed.ADVICE_SIZE, fixed.ADVICE_IMPORTS):
        assert text in advice, text


def test_blanked_values(files):
    for name in BLANKED:
        share = files[f"no_{name}"].mean()
        assert 0 < share < 1, name
