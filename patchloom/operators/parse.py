"""Diff text to tables: files, hunks and lines.

Every function here is map-only.  A diff is split into file sections, a section
into hunks and a hunk into lines by explodes over split text, so no row ever
leaves the task that read it.  Position columns (``file_seq``, ``hunk_seq``,
``line_seq``, all starting at 1) carry the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import strip

DIFF_ID = ("diff_id",)

FILE_HEADER = r"^diff --git a/([^\n]*?) b/([^\n]*)"
HUNK_HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@([^\n]*)"
FILE_MARK = "diff --git"


def from_place(parts: Column, first: Column) -> Column:
    """The elements of an array from the 1-based place ``first`` on."""
    return F.filter(parts, lambda part, i: i + 1 >= first)


def fixed_columns(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """Compute ``columns`` once per row, next to the ``keep`` columns.

    A plain projection lets the optimizer copy long expressions into every
    filter on their results, which evaluates them twice and, over several
    steps, makes the plan explode.  A one-element generator is not looked
    through, while filters on the ``keep`` columns still reach the scan.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))


def explode_rows(df: DataFrame, keep: Sequence[str], values: Column, pos: str, name: str) -> DataFrame:
    """Rows of an array with their positions; ``values`` is evaluated once.

    The inner form of the explode would test the array's size in a filter of
    its own, that is split the text a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias(pos, name))
    return rows.where(F.col(pos).isNotNull())


def file_sections(
    diffs: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    text_col: str = "diff_text",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per file of each diff: keys, ``file_seq``, ``section``.

    Text before the first file is dropped.  With ``keep_empty`` a diff that
    holds no file keeps one row whose ``file_seq`` and ``section`` are NULL.
    """
    text = F.col(text_col)
    first_file = F.when(text.startswith(FILE_MARK), 1).otherwise(2)
    sections = from_place(F.split(text, r"\n(?=diff --git)"), first_file)
    rows = (
        diffs.select(*keys, F.posexplode_outer(sections).alias("file_pos", "section"))
        if keep_empty
        else explode_rows(diffs, keys, sections, "file_pos", "section")
    )
    return rows.select(*keys, (F.col("file_pos") + 1).cast("bigint").alias("file_seq"), "section")


def _last(pattern: str, text: Column) -> Column:
    """Group 1 of the last line that matches, NULL when none does."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def _valid_hunks(parts: Column) -> Column:
    return F.filter(from_place(parts, F.lit(2)), lambda p: p.rlike(HUNK_HEADER))


def files_from_sections(sections: DataFrame, keys: Sequence[str] = DIFF_ID) -> DataFrame:
    """Paths, kind, line counts and changed lines of each file section."""
    parts = sections.select(
        *keys, "file_seq", F.split("section", r"\n(?=@@)").alias("parts")
    )
    header, body = F.col("header"), F.col("body")
    split_out = parts.select(
        *keys,
        "file_seq",
        F.get("parts", F.lit(0)).alias("header"),
        F.array_join(_valid_hunks(F.col("parts")), "\n").alias("body"),
    )
    read = fixed_columns(
        split_out,
        [*keys, "file_seq"],
        header_ok=header.rlike(FILE_HEADER),
        header_old=F.regexp_extract(header, FILE_HEADER, 1),
        header_new=F.regexp_extract(header, FILE_HEADER, 2),
        renamed_from=_last(r"\nrename from ([^\n]*)", header),
        renamed_to=_last(r"\nrename to ([^\n]*)", header),
        mark=_last(r"\n(rename from |new file mode|deleted file mode)", header),
        added_lines=F.regexp_extract_all(body, F.lit(r"\n\+([^\n]*)"), F.lit(1)),
        removed_lines=F.regexp_extract_all(body, F.lit(r"\n-([^\n]*)"), F.lit(1)),
    )
    moved = F.col("header_ok") & (F.col("header_old") != F.col("header_new"))
    return read.select(
        *keys,
        "file_seq",
        F.coalesce(
            "renamed_to", F.when(F.col("header_ok"), F.col("header_new")),
            F.when(F.col("file_seq").isNotNull(), F.lit("unknown")),
        ).alias("filename"),
        F.when(F.col("mark") == "rename from ", "renamed")
        .when(F.col("mark") == "new file mode", "added")
        .when(F.col("mark") == "deleted file mode", "deleted")
        .when(moved, "renamed")
        .when(F.col("file_seq").isNotNull(), "modified")
        .alias("change_type"),
        F.coalesce("renamed_from", F.when(moved, F.col("header_old"))).alias("old_filename"),
        F.size("added_lines").cast("bigint").alias("lines_added"),
        F.size("removed_lines").cast("bigint").alias("lines_removed"),
        "added_lines",
        "removed_lines",
    )


def parse_files(
    diffs: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    text_col: str = "diff_text",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per changed file.

    Columns: keys, ``file_seq``, ``filename``, ``change_type``,
    ``old_filename``, ``lines_added``, ``lines_removed`` and the changed lines
    ``added_lines`` / ``removed_lines`` in order.
    """
    return files_from_sections(file_sections(diffs, keys, text_col, keep_empty), keys)


def _hunk_rows(texts: DataFrame, keys: Sequence[str], first_hunk: Column, text_col: str) -> DataFrame:
    parts = from_place(F.split(F.col(text_col), r"\n(?=@@)"), first_hunk)
    valid = F.filter(parts, lambda p: p.rlike(HUNK_HEADER))
    hunk = F.col("hunk")
    rows = explode_rows(texts, keys, valid, "hunk_pos", "hunk")

    def number(group: int, default: Column | None = None) -> Column:
        digits = F.nullif(F.regexp_extract(hunk, HUNK_HEADER, group), F.lit(""))
        value = digits.try_cast("bigint")
        return value if default is None else F.when(digits.isNull(), default).otherwise(value)

    return rows.select(
        *keys,
        (F.col("hunk_pos") + 1).cast("bigint").alias("hunk_seq"),
        number(1).alias("old_start"),
        number(2, F.lit(1).cast("bigint")).alias("old_count"),
        number(3).alias("new_start"),
        number(4, F.lit(1).cast("bigint")).alias("new_count"),
        strip(F.regexp_extract(hunk, HUNK_HEADER, 5)).alias("context"),
        hunk,
    )


def _with_hunk_text(diffs: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    sections = file_sections(diffs, keys, text_col)
    return _hunk_rows(sections, [*keys, "file_seq"], F.lit(2), "section")


def parse_hunks(
    diffs: DataFrame, keys: Sequence[str] = DIFF_ID, text_col: str = "diff_text"
) -> DataFrame:
    """One row per valid hunk: ranges and context from the hunk header."""
    return _with_hunk_text(diffs, keys, text_col).drop("hunk")


def _lines_of(hunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of each hunk with their running line numbers.

    An added line carries the new-side number, every other line the old-side
    one.  A line's number is its rank among the lines of its side, so each side
    is filtered and numbered by position: linear work, and no window.
    """
    lines = from_place(F.split("hunk", "\n"), F.lit(2))
    prefix = lambda line: F.left(line, F.lit(1))
    typed = hunks.withColumn(
        "typed",
        F.transform(
            lines,
            lambda line, i: F.struct(
                (i + 1).cast("bigint").alias("line_seq"),
                F.when(prefix(line).isin("+", "-"), prefix(line))
                .otherwise(F.lit(" "))
                .alias("line_type"),
                F.when(prefix(line).isin("+", "-", " "), F.substr(line, F.lit(2)))
                .otherwise(line)
                .alias("content"),
            ),
        ),
    )

    def numbered(side: Column, start: str) -> Column:
        return F.transform(
            side,
            lambda line, i: F.struct(
                line["line_seq"].alias("line_seq"),
                line["line_type"].alias("line_type"),
                line["content"].alias("content"),
                (F.col(start) + i).alias("line_number"),
            ),
        )

    new_side = F.filter("typed", lambda line: line["line_type"] != "-")
    old_side = F.filter("typed", lambda line: line["line_type"] != "+")
    added = F.filter(numbered(new_side, "new_start"), lambda line: line["line_type"] == "+")
    lines = F.inline_outer(F.concat(added, numbered(old_side, "old_start")))
    return typed.select(*keys, lines).where(F.col("line_seq").isNotNull())


def parse_lines(
    diffs: DataFrame, keys: Sequence[str] = DIFF_ID, text_col: str = "diff_text"
) -> DataFrame:
    """One row per hunk line: type, content without its prefix, line number."""
    return _lines_of(_with_hunk_text(diffs, keys, text_col), [*keys, "file_seq", "hunk_seq"])


def extract_hunks(
    fragments: DataFrame, keys: Sequence[str] = ("fragment_id",), text_col: str = "text"
) -> DataFrame:
    """Hunks of text that has no file header.

    A ``diff --git`` line ends the hunk before it; what follows up to the next
    ``@@`` belongs to no hunk.
    """
    return _fragment_hunks(fragments, keys, text_col).drop("hunk")


def extract_lines(
    fragments: DataFrame, keys: Sequence[str] = ("fragment_id",), text_col: str = "text"
) -> DataFrame:
    """Lines of text that has no file header."""
    return _lines_of(_fragment_hunks(fragments, keys, text_col), [*keys, "hunk_seq"])


def _fragment_hunks(fragments: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    cut = fragments.select(
        *keys,
        F.transform(
            F.split(F.col(text_col), r"\n(?=@@)"),
            lambda p: F.get(F.split(p, r"\n(?=diff --git)"), F.lit(0)),
        ).alias("parts"),
    )
    hunks = cut.select(*keys, F.array_join("parts", "\n").alias("text"))
    first = F.when(F.col("text").startswith("@@"), 1).otherwise(2)
    return _hunk_rows(hunks, keys, first, "text")
