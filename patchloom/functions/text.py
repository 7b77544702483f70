"""Text predicates and helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"


# The same blanks, spelled out.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_sql(text: str) -> str:
    return f"btrim({text}, {sql_text(BLANKS)})"


def strip(text: Column) -> Column:
    """Trim blanks of any script from both ends, in one look at each end."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and all-blank text."""
    return ~F.coalesce(text.rlike(rf"[^{ANY_BLANK}]"), F.lit(False))


def looks_like_diff(text: Column) -> Column:
    """True when the text carries the marks of a diff."""
    marks = F.contains(text, F.lit("diff --git")) | (
        F.contains(text, F.lit("---")) & F.contains(text, F.lit("+++")) & F.contains(text, F.lit("@@"))
    )
    return F.coalesce(marks, F.lit(False))


def sql_text(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def lines_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def json_string_sql(text: str) -> str:
    """SQL of a JSON string literal; only quotes, backslashes and control codes are escaped."""
    plain = rf"replace(replace({text}, '\\', '\\\\'), '\"', '\\\"')"
    short = {8: r"\\b", 9: r"\\t", 10: r"\\n", 12: r"\\f", 13: r"\\r"}
    coded = plain
    for code in range(32):
        coded = f"replace({coded}, char({code}), '{short.get(code, rf'\\u{code:04x}')}')"
    controls = r"'[\\x00-\\x1f]'"
    return (
        f"coalesce(concat('\"', CASE WHEN {text} RLIKE {controls} THEN {coded} ELSE {plain} END, '\"'), 'null')"
    )
