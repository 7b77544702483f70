"""From diffs to reports in one call each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from patchloom.operators.analysis import analyze_files
from patchloom.operators.elements import Patterns
from patchloom.operators.parse import DIFF_ID, parse_files
from patchloom.operators.render import render
from patchloom.operators.summary import statistics, summarize


def diff_statistics(diffs: DataFrame, keys: Sequence[str] = DIFF_ID) -> DataFrame:
    """File and line counts of every diff; diffs without files count zero."""
    return statistics(parse_files(diffs, keys, keep_empty=True), keys)


def analyze_diffs(
    diffs: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    compat: bool = False,
    patterns: Patterns | None = None,
    extensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """One analysed row per changed file; map-only.

    ``patterns`` replace the built-in ones, ``extensions`` add to the built-in ones.
    """
    return analyze_files(parse_files(diffs, keys), keys, compat, patterns=patterns, extensions=extensions)


def summarize_diffs(
    diffs: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    compat: bool = False,
    with_files: bool = True,
    patterns: Patterns | None = None,
    extensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """One summary row per diff, also for diffs that hold no file."""
    files = parse_files(diffs, keys, keep_empty=True)
    analysis = analyze_files(
        files, keys, compat, keep_empty=True, patterns=patterns, extensions=extensions
    )
    return summarize(analysis, keys, known_purposes=True, with_files=with_files)


def render_diffs(
    diffs: DataFrame,
    format_name: str = "plain",
    template: str | None = None,
    template_name: str | None = None,
    templates: Mapping[str, str] | None = None,
    keys: Sequence[str] = DIFF_ID,
    compat: bool = False,
    patterns: Patterns | None = None,
    extensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """The rendered report of every diff."""
    summaries = summarize_diffs(diffs, keys, compat, patterns=patterns, extensions=extensions)
    return render(summaries, format_name, template, template_name, templates, keys)
