"""Purpose, impact and complexity of each changed file.

Row-local throughout: a file's verdict depends on that file alone, so the
analysis of a whole history is one scan without an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import fixed_values as fixed
from patchloom.functions.language import detect_language
from patchloom.functions.regex import checked_patterns
from patchloom.functions.text import sql_text
from patchloom.operators.elements import ELEMENTS, Patterns, structural_changes
from patchloom.operators.parse import DIFF_ID, fixed_columns


def _texts(*candidates: str) -> Column:
    return F.expr(f"array_compact(array({', '.join(candidates)}))")


def _case(*branches: tuple[str, str | int], otherwise: str = "NULL") -> str:
    """SQL of a CASE; results are texts or numbers."""
    result = lambda value: sql_text(value) if isinstance(value, str) else str(value)
    whens = " ".join(f"WHEN {condition} THEN {result(value)}" for condition, value in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def _by_kind(table: dict[str, str | int], otherwise: str = "NULL") -> str:
    return _case(*[(f"change_type = '{k}'", v) for k, v in table.items()], otherwise=otherwise)


def _has(change_type: str) -> str:
    return f"exists(change_types, t -> contains(t, '{change_type}'))"


def _words(text: str, table: dict[str, list[str]]) -> list[str]:
    hit = lambda words: " OR ".join(f"contains({text}, {sql_text(w)})" for w in words)
    return [_case((hit(words), name)) for name, words in table.items()]


def split_sides(files: DataFrame, lines_col: str = "lines") -> DataFrame:
    """``added_lines`` and ``removed_lines`` from an array of typed lines."""
    side = lambda kind: F.transform(
        F.filter(lines_col, lambda x: x["line_type"] == kind), lambda x: x["content"]
    )
    return files.select("*", side("+").alias("added_lines"), side("-").alias("removed_lines"))


def _purposes() -> Column:
    added, removed = _has("function_added"), _has("function_removed")
    return _texts(
        _by_kind(fixed.PURPOSE_BY_KIND),
        _case(
            (f"{added} AND NOT {removed}", fixed.PURPOSE_FUNCTION_ADDED),
            (f"{removed} AND NOT {added}", fixed.PURPOSE_FUNCTION_REMOVED),
            (_has("function_modified"), fixed.PURPOSE_FUNCTION_MODIFIED),
        ),
        _case(
            (_has("class_added"), fixed.PURPOSE_CLASS_ADDED),
            (_has("class_removed"), fixed.PURPOSE_CLASS_REMOVED),
            (_has("class_modified"), fixed.PURPOSE_CLASS_MODIFIED),
        ),
        _case(
            (_has("import_added"), fixed.PURPOSE_IMPORT_ADDED),
            (_has("import_removed"), fixed.PURPOSE_IMPORT_REMOVED),
        ),
        *_words("added_text", fixed.PURPOSE_BY_ADDED_WORDS),
        *_words("removed_text", fixed.PURPOSE_BY_REMOVED_WORDS),
        _case(
            (
                "language IN ('markdown', 'unknown') AND contains(lower(filename), 'readme')",
                fixed.PURPOSE_README,
            )
        ),
        *_words("added_text", fixed.PURPOSE_BY_COMMENT_MARKS),
    )


def _impacts() -> Column:
    changed = "lines_added + lines_removed"
    public = "size(elements) - n_private"
    ends = lambda suffixes: " OR ".join(f"endswith(filename, '{s}')" for s in suffixes)
    type_has = lambda word: f"exists(change_types, t -> contains(t, '{word}'))"
    return _texts(
        _by_kind(fixed.IMPACT_BY_KIND),
        _case(
            (f"{changed} > {fixed.IMPACT_LARGE_OVER}", fixed.IMPACT_LARGE),
            (f"{changed} > {fixed.IMPACT_MEDIUM_OVER}", fixed.IMPACT_MEDIUM),
            otherwise=sql_text(fixed.IMPACT_SMALL),
        ),
        f"CASE WHEN {public} > 0 THEN format_string({sql_text(fixed.IMPACT_PUBLIC)}, {public}) END",
        f"CASE WHEN n_private > 0 THEN format_string({sql_text(fixed.IMPACT_PRIVATE)}, n_private) END",
        _case((type_has("class"), fixed.IMPACT_CLASS)),
        _case((type_has("import"), fixed.IMPACT_IMPORT)),
        _case(*[(ends(suffixes), text) for suffixes, text in fixed.IMPACT_BY_SUFFIX]),
    )


def _score() -> Column:
    listed = lambda values: ", ".join(sql_text(v) for v in values)
    by_lines = _case(
        *[(f"lines_added + lines_removed > {over}", n) for over, n in fixed.SCORE_BY_LINES_OVER],
        otherwise="0",
    )
    heavy = f"arrays_overlap(change_types, array({listed(fixed.SCORE_HEAVY_TYPES)}))"
    raw = (
        f"({by_lines} + least(size(elements), {fixed.SCORE_MAX_ELEMENTS})"
        f" + {_case((heavy, fixed.SCORE_HEAVY), otherwise='0')}"
        f" + least(n_modified, {fixed.SCORE_MAX_MODIFIED}))"
    )
    by_language = (
        f"CASE WHEN language IN ({listed(fixed.SCORE_HARDER_LANGUAGES)}) THEN {raw} + 1"
        f" WHEN language IN ({listed(fixed.SCORE_EASIER_LANGUAGES)}) THEN greatest({raw} - 1, 0)"
        f" ELSE {raw} END"
    )
    by_kind = _by_kind(fixed.SCORE_BY_KIND, otherwise="0")
    return F.expr(f"least({by_language} + {by_kind}, {fixed.SCORE_CAP})")


def analyze_files(
    files: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    compat: bool = False,
    patterns: Patterns | None = None,
    keep_empty: bool = False,
    extensions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Language, elements, purpose, impact and score of each changed file.

    Takes rows as ``parse_files`` makes them.  A file without a name is left
    out; with ``keep_empty`` its row stays with a NULL name so that its change
    set is not lost.  With ``compat`` a file in which a pattern without a group
    matched counts as failed: its text becomes "Analysis failed", its score 0.

    User ``patterns`` are Python ``re`` patterns, translated to the engine's
    dialect by ``to_engine``.  A language with a pattern that can't run is
    left out: its files count as failed as above, and all others go on.
    ``checked_patterns`` tells why.
    """
    named = files.withColumn("filename", F.nullif("filename", F.lit("")))
    if not keep_empty:
        named = files.where(F.col("filename") != "")
    refused = {}
    if patterns:
        patterns, refused = checked_patterns(patterns, files.sparkSession)
    found = structural_changes(
        named.withColumn("language", detect_language(F.col("filename"), extensions)),
        **({"patterns": patterns} if patterns or refused else {}),
    )
    carried = [
        *keys,
        "file_seq",
        "filename",
        "change_type",
        "old_filename",
        "language",
        "lines_added",
        "lines_removed",
    ]
    failed = F.col("matched_without_name") if compat else F.lit(False)
    if refused:
        failed = failed | F.coalesce(F.col("language").isin(list(refused)), F.lit(False))
    counted = found.select(
        *carried,
        "elements",
        failed.alias("failed"),
        F.expr("lower(array_join(added_lines, '\\n')) AS added_text"),
        F.expr("lower(array_join(removed_lines, '\\n')) AS removed_text"),
        F.expr("array_distinct(transform(elements, e -> e.change_type)) AS change_types"),
        F.expr("size(filter(elements, e -> startswith(e.element_name, '_'))) AS n_private"),
        F.expr("size(filter(elements, e -> contains(e.change_type, 'modified'))) AS n_modified"),
    )
    judged = fixed_columns(
        counted,
        [*carried, "elements", "failed"],
        found_purposes=_purposes(),
        found_impacts=_impacts(),
        score=_score(),
    )
    # Rows without a name only keep their change set; failed files keep their counts.
    chosen = lambda name, value, on_failure: F.expr(
        f"CASE WHEN filename IS NULL THEN NULL WHEN failed THEN {on_failure} ELSE {value} END AS {name}"
    )
    default = sql_text(fixed.PURPOSE_DEFAULT)
    purposes = f"CASE WHEN size(found_purposes) = 0 THEN array({default}) ELSE found_purposes END"
    listed = judged.select(
        *carried,
        chosen("elements", "elements", f"cast(array() AS {ELEMENTS})"),
        chosen("purposes", purposes, f"array({sql_text(fixed.PURPOSE_FAILED)})"),
        chosen("impacts", "found_impacts", f"array({sql_text(fixed.IMPACT_FAILED)})"),
        chosen("complexity_score", "score", "0"),
        chosen("status", "'ok'", "'failed'"),
    )
    joined = lambda name, source: F.expr(
        f"CASE WHEN filename IS NOT NULL THEN array_join({source}, '; ') END AS {name}"
    )
    return listed.select(
        *carried,
        "elements",
        "purposes",
        joined("purpose_inference", "purposes"),
        "impacts",
        joined("impact_assessment", "impacts"),
        "complexity_score",
        "status",
    )
