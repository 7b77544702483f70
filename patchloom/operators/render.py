"""Summaries as text: plain, Markdown, JSON or a user template.

Every renderer is a projection over one summary row.  ``render_parts`` gives
the same text in pieces, one per file, for change sets too large for one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.fixed_values import (
    COUNTER_LABELS,
    FORMATS,
    NO_FILE_SUMMARIES,
    ROLLUP_FAILED,
    TEMPLATE_VARIABLES,
)
from patchloom.functions.text import json_string_sql
from patchloom.operators.parse import DIFF_ID
from patchloom.operators.summary import STAT_NAMES


def supported_formats() -> list[str]:
    return list(FORMATS)


def is_supported_format(name: str) -> bool:
    return name.lower() in FORMATS


def _bullets(items: str, mark: str = "- ") -> str:
    return f"transform({items}, x -> concat('{mark}', x))"


def _numbered(items: str) -> str:
    return f"transform({items}, (x, i) -> concat('  ', i + 1, '. ', x))"


def _strings(*texts: str) -> str:
    return "array(" + ", ".join(f"'{text}'" for text in texts) + ")"


def _if_any(items: str, lines: str) -> str:
    return f"CASE WHEN size({items}) > 0 THEN {lines} ELSE cast(array() AS array<string>) END"


def _section(title: str, items: str, body: str) -> str:
    """Title, body and a blank line; nothing when there are no items."""
    return _if_any(items, f"concat({_strings(title)}, {body}, {_strings('')})")


def _statistics(line: str) -> str:
    """Counter lines; counters of a file kind are left out when zero."""
    entries = []
    for name, label in COUNTER_LABELS.items():
        value = f"statistics.{name}"
        sign = {"total_lines_added": "+", "total_lines_removed": "-"}.get(name, "")
        text = f"concat('{line % label} {sign}', {value})"
        entries.append(f"CASE WHEN {value} > 0 THEN {text} END" if name.startswith("files_") else text)
    return f"array_compact(array({', '.join(entries)}))"


# Each layout is SQL of arrays of lines: head, title of the file list, one file
# ``f`` and tail.  Its titles and marks are fixed values.
_LAYOUTS = {
    "markdown": (
        f"concat({_strings('# Code Change Summary', '', '## Overview')}, array(overview),"
        f" {_strings('', '## Statistics')}, {_statistics('- **%s:**')}, {_strings('')},"
        f" {_section('## Key Changes', 'key_changes', _bullets('key_changes'))})",
        _strings("## File Details"),
        "concat(array(concat('### ', f.filename), f.summary), "
        + _if_any(
            "f.key_changes", f"concat({_strings('', '**Key changes:**')}, {_bullets('f.key_changes')})"
        )
        + f", {_strings('')})",
        _section("## Recommendations", "recommendations", _bullets("recommendations")),
    ),
    "plain": (
        f"concat({_strings('CODE CHANGE SUMMARY', '=' * 50, '', 'OVERVIEW:')}, array(overview),"
        f" {_strings('', 'STATISTICS:')}, {_statistics('  %s:')}, {_strings('')},"
        f" {_section('KEY CHANGES:', 'key_changes', _numbered('key_changes'))})",
        _strings("FILE DETAILS:", "-" * 30),
        "concat(array(concat('File: ', f.filename), concat('Summary: ', f.summary)), "
        + _if_any(
            "f.key_changes", f"concat({_strings('Key changes:')}, {_bullets('f.key_changes', '  - ')})"
        )
        + f", {_strings('')})",
        _section("RECOMMENDATIONS:", "recommendations", _numbered("recommendations")),
    ),
}


def _joined(lines: str) -> str:
    return f"array_join({lines}, '\\n')"


def _laid_out(layout: str) -> Column:
    head, title, file_lines, tail = _LAYOUTS[layout]
    files = f"flatten(transform(file_summaries, f -> {file_lines}))"
    details = _if_any("file_summaries", f"concat({title}, {files})")
    return F.expr(_joined(f"concat({head}, {details}, {tail})"))


def as_markdown() -> Column:
    return _laid_out("markdown")


def as_plain() -> Column:
    return _laid_out("plain")


def _json_list(items: str, indent: int) -> str:
    pad = "\\n" + " " * indent
    return (
        f"CASE WHEN size({items}) > 0 THEN concat('[{pad}  ', array_join({items}, ',{pad}  '), '{pad}]') ELSE '[]' END"
    )


def _json_strings(items: str) -> str:
    return f"transform({items}, x -> {json_string_sql('x')})"


def _json_head() -> str:
    """The JSON up to ``"file_summaries": ``."""
    counters = ", ".join(
        f"""'    "{name}": ', statistics.{name}, '{",\\n" if name != STAT_NAMES[-1] else ""}'"""
        for name in STAT_NAMES
    )
    return f"""concat('{{\\n  "overview": ', {json_string_sql("overview")},
        ',\\n  "statistics": {{\\n', {counters}, '\\n  }},\\n  "file_summaries": ')"""


def _json_file(f: str) -> str:
    return f"""concat('{{\\n      "filename": ', {json_string_sql(f"{f}.filename")},
        ',\\n      "summary": ', {json_string_sql(f"{f}.summary")},
        ',\\n      "key_changes": ', {_json_list(_json_strings(f"{f}.key_changes"), 6)}, '\\n    }}')"""


def _json_tail() -> str:
    """The JSON after the file list."""
    return f"""concat(',\\n  "key_changes": ', {_json_list(_json_strings("key_changes"), 2)},
        ',\\n  "recommendations": ', {_json_list(_json_strings("recommendations"), 2)}, '\\n}}')"""


def as_json() -> Column:
    """JSON with an indent of two; only quotes, backslashes and control codes are escaped."""
    files = _json_list(f"transform(file_summaries, f -> {_json_file('f')})", 2)
    return F.expr(f"concat({_json_head()}, {files}, {_json_tail()})")


def template_file_block(files: str = "file_summaries") -> Column:
    """"- file: summary" lines with their key changes below."""
    lines = (
        f"flatten(transform({files}, f -> concat(array(concat('- ', f.filename, ': ', f.summary)),"
        f" {_bullets('f.key_changes', '  - ')})))"
    )
    return F.expr(f"CASE WHEN size({files}) > 0 THEN {_joined(lines)} ELSE '{NO_FILE_SUMMARIES}' END")


def _template_values() -> dict[str, Column]:
    counter = lambda name: F.col(f"statistics.{name}").cast("string")
    values = [
        F.coalesce("overview", F.lit("")),
        counter("total_files"),
        counter("files_added"),
        counter("files_modified"),
        counter("files_deleted"),
        counter("total_lines_added"),
        counter("total_lines_removed"),
        F.expr(_joined(_bullets("key_changes"))),
        F.expr(_joined(_bullets("recommendations"))),
        template_file_block(),
    ]
    return dict(zip(TEMPLATE_VARIABLES, values, strict=True))


def from_template(template: str) -> Column:
    """A template with ``{variable}`` fields as one column expression.

    The template is read once, when the plan is made.  Unknown variables,
    malformed braces, conversions and format codes raise ``ValueError``.
    """
    if not template:
        raise ValueError("Template cannot be empty")
    values = _template_values()
    pieces = []
    try:
        parsed = list(Formatter().parse(template))
    except ValueError as error:
        raise ValueError(f"Error applying template: {error}") from error
    for text, name, code, conversion in parsed:
        if text:
            pieces.append(F.lit(text))
        if name is None:
            continue
        if name not in values:
            raise ValueError(f"Template variable not found: {name!r}")
        if code or conversion:
            raise ValueError("Error applying template: only plain {variable} fields are supported")
        pieces.append(values[name])
    return F.concat(*pieces)


def _format_column(name: str) -> Column:
    return {
        "json": as_json,
        "markdown": as_markdown,
        "md": as_markdown,
        "plain": as_plain,
        "text": as_plain,
    }[name]()


def _checked(format_name: str) -> str:
    if not format_name:
        raise ValueError("Format type cannot be empty")
    if not is_supported_format(format_name):
        raise ValueError(f"Unsupported format type: {format_name.lower()}")
    return format_name.lower()


def render(
    summaries: DataFrame,
    format_name: str = "plain",
    template: str | None = None,
    template_name: str | None = None,
    templates: Mapping[str, str] | None = None,
    keys: Sequence[str] = DIFF_ID,
) -> DataFrame:
    """Keys and ``rendered``.  A template wins over a named one, that over the format."""
    if template:
        text = from_template(template)
    elif template_name:
        text = from_template(find_template(template_name, templates or {}))
    else:
        text = _format_column(_checked(format_name))
    return summaries.select(*keys, text.alias("rendered"))


def render_by_column(
    summaries: DataFrame, format_col: str = "format", keys: Sequence[str] = DIFF_ID
) -> DataFrame:
    """As ``render``, each row in the format its own column names."""
    name = F.lower(F.col(format_col))
    text = (
        F.when(name == "json", as_json())
        .when(name.isin("markdown", "md"), as_markdown())
        .when(name.isin("plain", "text"), as_plain())
        .otherwise(
            F.raise_error(F.concat(F.lit("Unsupported format type: "), F.coalesce(name, F.lit(""))))
        )
    )
    return summaries.select(*keys, format_col, text.alias("rendered"))


def apply_template(summaries: DataFrame, template: str, keys: Sequence[str] = DIFF_ID) -> DataFrame:
    return summaries.select(*keys, from_template(template).alias("rendered"))


def find_template(name: str, templates: Mapping[str, str]) -> str:
    if name not in templates:
        raise ValueError(f"Template '{name}' not found in configuration")
    return templates[name]


def list_templates(templates: Mapping[str, str]) -> dict[str, str]:
    return dict(templates)


def render_parts(
    headers: DataFrame,
    files: DataFrame,
    format_name: str = "plain",
    keys: Sequence[str] = DIFF_ID,
) -> DataFrame:
    """The plain or Markdown text in pieces: keys, ``part``, ``text``.

    ``headers`` comes from ``summarize(..., with_files=False)``, ``files`` from
    ``file_summaries``.  Joined by line feeds in order of ``part`` the pieces
    are the text ``render`` gives.  No row holds more than one file.
    """
    layout = {"md": "markdown", "text": "plain"}.get(_checked(format_name), _checked(format_name))
    if layout == "json":
        return _json_parts(headers, files, keys)
    if layout not in _LAYOUTS:
        raise ValueError("Only plain, Markdown and JSON text come in parts")
    head, title, file_lines, tail = _LAYOUTS[layout]
    titled = f"CASE WHEN statistics.total_files > 0 THEN concat({head}, {title}) ELSE {head} END"
    last = f"CASE WHEN size(recommendations) > 0 THEN {_joined(tail)} END"
    # Files are numbered from 1; the tail stands after the last possible one.
    ends = F.expr(
        f"inline(array(named_struct('part', 0L, 'text', {_joined(titled)}),"
        f" named_struct('part', {(1 << 63) - 1}, 'text', {last})))"
    )
    around = headers.select(*keys, ends).where(F.col("text").isNotNull())
    rows = files.select(
        *keys, F.col("file_seq").alias("part"), F.struct("filename", "summary", "key_changes").alias("f")
    )
    return around.unionByName(rows.select(*keys, "part", F.expr(f"{_joined(file_lines)} AS text")))


#: Parts of one change set's file list are matched to it over this many salts.
SALTS = 16


def _json_parts(headers: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JSON in pieces: the head up to the file list, one piece per file, the tail.

    A file's piece ends with a comma unless it is its change set's last.  Files
    meet their header over ``SALTS`` salts, so that a change set of very many
    files is no single task; the last file of each salt then meets the others
    and the header's own row, which no file's salt shares.  So headers and files
    are each computed once.  Change sets whose roll-up failed list no file, as
    in ``render``.
    """
    for key in keys:
        headers, files = headers.where(F.col(key).isNotNull()), files.where(F.col(key).isNotNull())
    opened = headers.select(
        *keys, F.expr(_json_head()).alias("opening"), F.expr(_json_tail()).alias("closing"),
        (F.col("overview") == ROLLUP_FAILED).alias("failed"), F.explode(F.sequence(F.lit(-1), F.lit(SALTS - 1))).alias("salt"))
    alone = F.col("salt") < 0
    texts = [F.when(alone, F.col(name)).alias(name) for name in ("opening", "closing")]
    entry = F.expr(f"concat('    ', {_json_file('struct(filename, summary, key_changes)')})").alias("entry")
    salt = F.pmod("file_seq", F.lit(SALTS)).cast("int").alias("salt")
    rows = opened.select(*keys, "salt", "failed", *texts).unionByName(
        files.select(*keys, salt, "file_seq", entry), allowMissingColumns=True)
    salted, placed = Window.partitionBy(*keys, "salt"), Window.partitionBy(*keys, "place")
    rows = rows.withColumn("failed", F.max("failed").over(salted))
    ahead = F.col("file_seq") < F.max("file_seq").over(salted)
    rows = rows.withColumn("place", F.when(ahead, F.col("salt")).otherwise(-1))
    rows = rows.where(F.col("failed").isNotNull() & (alone | F.col("file_seq").isNotNull()))
    rows = rows.withColumn("last_seq", F.max("file_seq").over(placed))
    listed = ~F.col("failed") & F.col("last_seq").isNotNull()
    comma = F.when((F.col("place") >= 0) | (F.col("file_seq") < F.col("last_seq")), ",").otherwise("")
    head = F.when(listed, F.concat("opening", F.lit("["))).otherwise(F.concat("opening", F.lit("[]"), "closing"))
    tail = F.when(listed, F.concat(F.lit("  ]"), "closing"))
    part = lambda number, text: F.struct(number.cast("bigint").alias("part"), text.alias("text"))
    ends = F.array(part(F.lit(0), head), part(F.lit((1 << 63) - 1), tail))
    piece = F.when(~F.col("failed"), F.concat("entry", comma))
    parts = F.when(alone, ends).otherwise(F.array(part(F.col("file_seq"), piece)))
    return rows.select(*keys, F.inline(parts)).where(F.col("text").isNotNull())
