"""Code elements: functions, classes, imports and the like, found by pattern.

Each pattern is a literal in the plan, so it is compiled once per task.  On a
changed file a pattern runs once over the whole added (or removed) text and
yields only the lines it matches; nothing is tried again line by line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.fixed_values import ANONYMOUS, ELEMENT_PATTERNS
from patchloom.functions.regex import group_count, spark_pattern, whole_line_pattern
from patchloom.functions.text import sql_text, strip, strip_sql
from patchloom.operators.parse import explode_rows, fixed_columns

Patterns = Mapping[str, Mapping[str, str]]

FOUND = "array<struct<element_type:string,name:string,own_name:string,content:string>>"
ELEMENTS = (
    "array<struct<change_type:string,element_name:string,description:string,"
    "before:string,after:string>>"
)


def _group(line: Column, pattern: str, index: int) -> Column:
    if index > group_count(pattern):
        return F.lit("")
    return F.regexp_extract(line, spark_pattern(pattern), index)


def _name(line: Column, pattern: str) -> Column:
    """First group that is not empty, else ``anonymous``."""
    groups = [
        F.nullif(_group(line, pattern, i), F.lit(""))
        for i in range(1, group_count(pattern) + 1)
    ]
    return F.coalesce(*groups, F.lit(ANONYMOUS))


def code_elements(
    code: DataFrame,
    code_col: str = "code",
    language_col: str = "language",
    keys: Sequence[str] = ("code_id",),
    patterns: Patterns = ELEMENT_PATTERNS,
) -> DataFrame:
    """Elements of any code text, one row each, with their 1-based line.

    Columns: keys, ``type_ord``, ``element_type``, ``name``, ``line``,
    ``content`` and, for functions whose pattern has two groups, ``parameters``.
    """
    line = F.col("text")
    lines = code.select(
        *keys,
        F.col(language_col).alias("language"),
        F.posexplode(F.split(F.col(code_col), "\n")).alias("pos", "text"),
    )

    def matches(by_type: Mapping[str, str]) -> Column:
        found = []
        for order, (element_type, pattern) in enumerate(by_type.items()):
            has_parameters = element_type == "function" and group_count(pattern) >= 2
            found.append(
                F.when(
                    line.rlike(spark_pattern(pattern)),
                    F.struct(
                        F.lit(order).alias("type_ord"),
                        F.lit(element_type).alias("element_type"),
                        _name(line, pattern).alias("name"),
                        strip(line).alias("content"),
                        (_group(line, pattern, 2) if has_parameters else F.lit(None).cast("string"))
                        .alias("parameters"),
                    ),
                )
            )
        return F.array_compact(F.array(*found))

    per_language = None
    for language, by_type in patterns.items():
        is_language = F.col("language") == language
        per_language = (
            F.when(is_language, matches(by_type))
            if per_language is None
            else per_language.when(is_language, matches(by_type))
        )
    rows = lines.select(*keys, (F.col("pos") + 1).alias("line"), F.inline_outer(per_language))
    return rows.where(F.col("type_ord").isNotNull()).select(
        *keys, "type_ord", "element_type", "name", "line", "content", "parameters"
    )


def _found_in(text: str, by_type: Mapping[str, str]) -> str:
    """SQL of the elements in a block of text, by type, then by line."""

    def of_type(element_type: str, pattern: str) -> str:
        one_line = sql_text(spark_pattern(pattern))
        groups = [f"regexp_extract(line, {one_line}, {i})" for i in range(1, group_count(pattern) + 1)]
        name = ", ".join([f"nullif({group}, '')" for group in groups] + [sql_text(ANONYMOUS)])
        return (
            f"transform(regexp_extract_all({text}, {sql_text(whole_line_pattern(pattern))}, 0), line -> named_struct("
            f"'element_type', {sql_text(element_type)}, 'name', coalesce({name}),"
            f" 'own_name', {groups[0] if groups else sql_text('')}, 'content', {strip_sql('line')}))"
        )

    return "concat(" + ", ".join(of_type(*item) for item in by_type.items()) + ")"


def _both_sides(patterns: Patterns) -> Column:
    """Elements found in the added and in the removed text of a file."""
    cases = " ".join(
        f"WHEN {sql_text(language)} THEN {_found_in('text', by_type)}"
        for language, by_type in patterns.items()
    )
    return F.expr(
        "transform(array(array_join(added_lines, '\\n'), array_join(removed_lines, '\\n')),"
        f" text -> CASE language {cases} ELSE cast(array() AS {FOUND}) END)"
    )


def _key(element: str, name: str) -> str:
    """One text per (type, name): the type's length, a colon, the type, the name.

    The length prefix keeps keys apart whatever the texts hold, and a text key
    hashes and compares in one step where a struct is compared field by field.
    """
    return (f"concat(cast(char_length({element}.element_type) AS string), ':',"
            f" {element}.element_type, {element}.{name})")


def _type_of(key: str) -> str:
    head = f"substring_index({key}, ':', 1)"
    return f"substr({key}, char_length({head}) + 2, cast({head} AS int))"


def _name_of(key: str) -> str:
    head = f"substring_index({key}, ':', 1)"
    return f"substr({key}, char_length({head}) + 2 + cast({head} AS int))"


def _not_modified(found: str) -> str:
    """SQL dropping the elements whose type and name are among the modified ones.

    A file may change very many names, so they are spread over about sqrt(n)
    buckets, and a lookup reads one bucket only.
    """
    key = _key("e", "name")
    bucket = f"try_element_at(modified_buckets, pmod(hash({key}), size(modified_buckets)) + 1)"
    kept = f"filter({found}, e -> NOT array_contains({bucket}, {key}))"
    return f"CASE WHEN size(modified_keys) = 0 THEN {found} ELSE {kept} END"


def structural_changes(
    files: DataFrame,
    patterns: Patterns = ELEMENT_PATTERNS,
) -> DataFrame:
    """Add ``elements`` (and ``matched_without_name``) to rows of changed files.

    Needs ``language``, ``added_lines`` and ``removed_lines``.  The list holds
    added, then removed, then modified elements.  An element is modified when
    its pattern's first group yields the same name on both sides; the entries
    of that type and name then leave the other two lists.
    ``matched_without_name`` tells whether a pattern without a group matched.
    """
    found = fixed_columns(
        files,
        files.columns,
        found=_both_sides(patterns),
    ).select(
        *files.columns,
        F.get("found", F.lit(0)).alias("found_added"),
        F.get("found", F.lit(1)).alias("found_removed"),
    )
    own_keys = lambda side: (
        f"transform(filter({side}, e -> e.own_name <> ''), e -> {_key('e', 'own_name')})"
    )
    both = f"array_intersect({own_keys('found_added')}, {own_keys('found_removed')})"
    keyed = fixed_columns(found, found.columns, modified_keys=F.expr(both))
    n_buckets = "cast(ceil(sqrt(size(modified_keys))) AS int)"
    bucketed = keyed.withColumn(
        "modified_buckets",
        F.expr(
            f"CASE WHEN size(modified_keys) > 0 THEN transform(sequence(0, {n_buckets} - 1), b ->"
            f" filter(modified_keys, k -> pmod(hash(k), {n_buckets}) = b)) END"
        ),
    )

    def entries(source: str, element_type: str, name: str, verb: str, before: str, after: str) -> str:
        return (
            f"transform({source}, e -> named_struct('change_type', concat({element_type}, '_{verb}'),"
            f" 'element_name', {name}, 'description',"
            f" concat('{verb.capitalize()} ', {element_type}, ' \\'', {name}, '\\''),"
            f" 'before', {before}, 'after', {after}))"
        )

    nothing = "cast(NULL AS string)"
    added = entries(
        _not_modified("found_added"), "e.element_type", "e.name", "added", nothing, "e.content"
    )
    removed = entries(
        _not_modified("found_removed"), "e.element_type", "e.name", "removed", "e.content", nothing
    )
    modified = entries(
        "modified_keys",
        _type_of("e"),
        _name_of("e"),
        "modified",
        nothing,
        nothing,
    )
    nameless = " OR ".join(
        f"(language = {sql_text(language)} AND exists(concat(found_added, found_removed),"
        f" e -> e.element_type = {sql_text(element_type)}))"
        for language, by_type in patterns.items()
        for element_type, pattern in by_type.items()
        if group_count(pattern) == 0
    )
    return fixed_columns(
        bucketed,
        files.columns,
        elements=F.expr(f"cast(concat({added}, {removed}, {modified}) AS {ELEMENTS})"),
        matched_without_name=F.expr(nameless or "false"),
    )


def element_rows(analysis: DataFrame, keys: Sequence[str] = ("diff_id",)) -> DataFrame:
    """The ``elements`` lists as rows, ``element_seq`` giving the place in the list."""
    rows = explode_rows(analysis, [*keys, "file_seq"], F.col("elements"), "pos", "e")
    return rows.select(*keys, "file_seq", (F.col("pos") + 1).cast("bigint").alias("element_seq"), "e.*")
