"""Language of a file, from its path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom import fixed_values as fixed
from patchloom.functions.text import sql_text


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items())
    return F.element_at(F.expr(f"map({pairs})"), key)


def detect_language(filename: Column, extensions: Mapping[str, str] | None = None) -> Column:
    """Special names first, then the text after the last dot, else ``unknown``.

    ``extensions`` (``{".ext": "language"}``, lower case) add to the built-in ones.
    """
    lowered = F.lower(filename)
    by_name = F.when(
        lowered.startswith(fixed.README_PREFIX), F.lit(fixed.README_LANGUAGE)
    ).otherwise(_lookup(fixed.LANGUAGE_BY_NAME, lowered))
    by_extension = F.when(
        F.contains(filename, F.lit(".")),
        _lookup(
            fixed.LANGUAGE_BY_EXTENSION | dict(extensions or {}),
            F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1))),
        ),
    )
    return F.when(
        filename.isNotNull(), F.coalesce(by_name, by_extension, F.lit(fixed.UNKNOWN))
    )
