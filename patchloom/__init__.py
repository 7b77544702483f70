"""Change-set analytics on Spark: tables of diffs in, tables and reports out."""

from patchloom.functions.language import detect_language
from patchloom.functions.text import is_blank, looks_like_diff
from patchloom.operators.analysis import analyze_files, split_sides
from patchloom.operators.elements import code_elements, element_rows, structural_changes
from patchloom.operators.parse import (
    extract_hunks,
    extract_lines,
    file_sections,
    files_from_sections,
    parse_files,
    parse_hunks,
    parse_lines,
)
from patchloom.operators.render import (
    apply_template,
    find_template,
    is_supported_format,
    list_templates,
    render,
    render_by_column,
    render_parts,
    supported_formats,
)
from patchloom.operators.summary import file_summaries, statistics, summarize, top_purposes
from patchloom.plans.reports import analyze_diffs, diff_statistics, render_diffs, summarize_diffs
from patchloom.sources.patch_files import (
    SECTION_KEYS,
    number_files,
    read_patch_files,
    read_patch_sections,
    write_parts,
    write_rendered,
    write_reports,
)

__all__ = [
    "SECTION_KEYS",
    "number_files",
    "analyze_diffs",
    "analyze_files",
    "apply_template",
    "code_elements",
    "detect_language",
    "diff_statistics",
    "element_rows",
    "extract_hunks",
    "extract_lines",
    "file_sections",
    "file_summaries",
    "files_from_sections",
    "find_template",
    "is_blank",
    "is_supported_format",
    "list_templates",
    "looks_like_diff",
    "parse_files",
    "parse_hunks",
    "parse_lines",
    "read_patch_files",
    "read_patch_sections",
    "render",
    "render_by_column",
    "render_diffs",
    "render_parts",
    "split_sides",
    "statistics",
    "structural_changes",
    "summarize",
    "summarize_diffs",
    "supported_formats",
    "top_purposes",
    "write_parts",
    "write_rendered",
    "write_reports",
]
