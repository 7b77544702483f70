"""Per-file summaries and the roll-up of each change set.

The roll-up is two plain aggregations.  The first groups by change set and by
chunk of ``CHUNK`` consecutive files, so no group ever holds more than
``CHUNK`` rows, however many files one change set has; each chunk keeps
counters and at most ten file names per rule.  The second merges the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom import fixed_values as fixed
from patchloom.functions.text import sql_text
from patchloom.operators.parse import DIFF_ID, explode_rows, fixed_columns

CHUNK = 4096
VERBS = ("added", "removed", "modified")
STRINGS = "array<string>"


def describe_elements(elements: str = "elements") -> Column:
    """"added function f, removed 2 functions; added class C": types in first-seen order."""
    base = "substring_index(e.change_type, '_', 1)"
    names = {
        verb: f"transform(filter({elements}, e -> {base} = g AND endswith(e.change_type, '_{verb}')), e -> e.element_name)"
        for verb in VERBS
    }
    phrases = ", ".join(
        f"CASE WHEN size({n}) = 1 THEN concat('{verb} ', g, ' ', get({n}, 0))"
        f" WHEN size({n}) > 1 THEN concat('{verb} ', size({n}), ' ', g, 's') END"
        for verb, n in names.items()
    )
    return F.expr(
        f"array_join(filter(transform(array_distinct(transform({elements}, e -> {base})),"
        f" g -> concat_ws(', ', {phrases})), text -> text <> ''), '; ')"
    )


def change_description() -> Column:
    """One sentence per file, over the columns ``analyze_files`` gives."""
    name = "'\\'', filename, '\\''"
    counts = (
        "concat_ws(', ', CASE WHEN lines_added > 0 THEN concat('+', lines_added, ' lines') END,"
        " CASE WHEN lines_removed > 0 THEN concat('-', lines_removed, ' lines') END)"
    )
    return F.concat_ws(
        " - ",
        F.expr(
            f"CASE change_type WHEN 'added' THEN concat('Added new file ', {name})"
            f" WHEN 'deleted' THEN concat('Deleted file ', {name})"
            f" WHEN 'renamed' THEN concat('Renamed \\'', coalesce(old_filename, 'None'), '\\' to ', {name})"
            f" ELSE concat('Modified ', {name}) END"
        ),
        F.expr(f"CASE WHEN lines_added > 0 OR lines_removed > 0 THEN concat('(', {counts}, ')') END"),
        F.nullif(describe_elements(), F.lit("")),
        F.expr(
            f"CASE WHEN purpose_inference NOT IN ('', '{fixed.PURPOSE_DEFAULT}')"
            " THEN concat('Purpose: ', purpose_inference) END"
        ),
    )


def file_key_changes() -> Column:
    """What stands out in one file: its elements, a high score, a high impact."""
    entry = " ".join(
        f"WHEN endswith(e.change_type, '_{verb}') THEN concat('{verb.capitalize()} ',"
        f" replace(e.change_type, '_{verb}', ''), ' \\'', e.element_name, '\\'')"
        for verb in VERBS
    )
    score = " ".join(
        f"WHEN complexity_score >= {least} THEN format_string('{text}', complexity_score)"
        for least, text in (
            (fixed.SCORE_HIGH, fixed.FILE_HIGH_SCORE),
            (fixed.SCORE_MEDIUM, fixed.FILE_MEDIUM_SCORE),
        )
    )
    return F.expr(
        f"array_compact(concat(transform(elements, e -> CASE {entry} END), array(CASE {score} END,"
        f" CASE WHEN contains(lower(impact_assessment), 'high impact') THEN '{fixed.FILE_HIGH_IMPACT}' END)))"
    )


def file_summaries(analysis: DataFrame, keys: Sequence[str] = DIFF_ID) -> DataFrame:
    """``summary`` and ``key_changes`` of each analysed file; map-only.

    A file whose counts, score or impact are missing gets a fallback text.
    """
    missing = F.expr(IS_MISSING)
    rows = analysis.where(F.col("file_seq").isNotNull() & F.col("filename").isNotNull())
    rows = rows.withColumn("elements", F.coalesce("elements", F.array().cast(_elements_type(analysis))))
    return rows.select(
        *keys,
        "file_seq",
        "filename",
        F.when(missing, F.concat(F.lit(fixed.FILE_SUMMARY_FAILED), F.col("filename")))
        .otherwise(change_description())
        .alias("summary"),
        F.when(missing, F.array().cast(STRINGS)).otherwise(file_key_changes()).alias("key_changes"),
    )


def _elements_type(analysis: DataFrame) -> str:
    return analysis.schema["elements"].dataType.simpleString()


def statistics(files: DataFrame, keys: Sequence[str] = DIFF_ID) -> DataFrame:
    """Counts of files by kind and of lines, per change set: one hash aggregate."""
    kind = lambda value: f"count_if(filename <> '' AND change_type = '{value}')"
    total = lambda name: f"coalesce(sum(CASE WHEN filename <> '' THEN {name} END), 0L)"
    return files.groupBy(*keys).agg(
        F.expr("count_if(filename <> '') AS total_files"),
        F.expr(f"{kind('added')} AS files_added"),
        F.expr(f"{kind('modified')} AS files_modified"),
        F.expr(f"{kind('deleted')} AS files_deleted"),
        F.expr(f"{total('lines_added')} AS total_lines_added"),
        F.expr(f"{total('lines_removed')} AS total_lines_removed"),
    )


def top_purposes(
    analysis: DataFrame, keys: Sequence[str] = DIFF_ID, limit: int = fixed.TOP_PURPOSES
) -> DataFrame:
    """The most frequent purposes of each change set, ties by first appearance.

    Works for any purpose text.  Counting is a two-stage aggregate on change
    set and purpose; the ranking keeps ``limit`` rows per change set on the map
    side already.
    """
    named = analysis.where(F.col("purpose_inference") != "")
    purposes = F.split("purpose_inference", "; ")
    parts = explode_rows(named, [*keys, "file_seq"], purposes, "pos", "purpose")
    # One number for (file_seq, pos): a fixed-width minimum keeps the aggregate hash-based.
    place = F.expr("cast(file_seq AS DECIMAL(20, 0)) * 4294967296 + pos")
    counted = parts.groupBy(*keys, "purpose").agg(
        F.count("*").alias("n_files"), F.min(place).alias("first_seen")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("n_files"), F.asc("first_seen"))
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(*keys, F.col("rank").cast("bigint").alias("rank"), "purpose", "n_files")
    )


def overview_text() -> Column:
    """The one-line overview from the six counters and the top purposes."""
    parts = ", ".join(
        f"CASE WHEN files_{word} > 0 THEN concat(files_{word}, ' {word}') END"
        for word in ("added", "modified", "deleted")
    )
    lines = (
        "concat_ws(', ', CASE WHEN total_lines_added > 0 THEN concat('+', total_lines_added) END,"
        " CASE WHEN total_lines_removed > 0 THEN concat('-', total_lines_removed) END)"
    )
    return F.expr(
        "concat(concat_ws('. ',"
        " CASE WHEN total_files = 1 THEN '1 file changed' ELSE concat(total_files, ' files changed') END,"
        f" {parts},"
        f" CASE WHEN total_lines_added > 0 OR total_lines_removed > 0 THEN concat('(', {lines}, ' lines)') END,"
        " CASE WHEN size(top) > 0 THEN concat('Primary focus: ', array_join(top, ', ')) END), '.')"
    )


# The lists of the key-change report, in order: a condition on a file each.
LISTS = [
    f"complexity_score >= {fixed.SCORE_HIGH}",
    "change_type = 'added'",
    "change_type = 'deleted'",
    f"lines_added + lines_removed > {fixed.LARGE_FILE_OVER}",
    f"size(filter(elements, e -> contains(e.change_type, 'class'))) > {fixed.CLASS_CHANGES_OVER}",
]


def _noted() -> Column:
    """The lists one file belongs to, as (list, file_seq, filename, lines)."""
    entries = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('list', {i}, 'file_seq', file_seq,"
        " 'filename', filename, 'n', lines_added + lines_removed) END"
        for i, condition in enumerate(LISTS)
    )
    return F.expr(f"array_compact(array({entries}))")


def _first_noted(entries: str) -> Column:
    """The first ten entries of each list; the entries come sorted by list and file."""
    firsts = ", ".join(
        f"slice(filter({entries}, x -> x.list = {i}), 1, {fixed.MAX_KEY_CHANGES})"
        for i in range(len(LISTS))
    )
    return F.expr(f"concat({firsts})")


def _purpose_entries(source: str = "purposes") -> Column:
    """A file's purposes as (minus count, first place, purpose)."""
    return F.expr(
        f"transform({source}, (p, i) -> named_struct("
        "'n', -1L, 'first', named_struct('file_seq', file_seq, 'pos', i), 'purpose', p))"
    )


#: Purposes of any text, from ``purpose_inference``; files without a name or a purpose have none.
OPEN_PURPOSES = (
    "CASE WHEN filename IS NOT NULL AND purpose_inference <> '' THEN split(purpose_inference, '; ') END"
)


def _counted_purposes(entries: str) -> Column:
    """Entries of the same purpose added up; the list has one entry per purpose."""
    return F.expr(
        f"transform(array_distinct(transform({entries}, x -> x.purpose)), p -> named_struct("
        f"'n', aggregate(filter({entries}, x -> x.purpose = p), 0L, (t, x) -> t + x.n),"
        f" 'first', array_min(transform(filter({entries}, x -> x.purpose = p), x -> x.first)),"
        " 'purpose', p))"
    )


def _key_changes() -> Column:
    """Texts of the five lists, the first ten in all."""
    named = lambda i, text: f"transform(filter(noted, x -> x.list = {i}), f -> {text})"
    starting = lambda i, words: named(i, f"concat('{words}', f.filename)")
    new = (
        f"CASE WHEN files_added > {fixed.NEW_FILES_LISTED} THEN"
        f" array(format_string('{fixed.NOTE_MANY_NEW}', files_added))"
        f" ELSE {starting(1, fixed.NOTE_NEW)} END"
    )
    large = named(3, f"format_string('{fixed.NOTE_LARGE}', f.filename, f.n)")
    return F.expr(
        f"slice(concat({starting(0, fixed.NOTE_HIGH)}, {new}, {starting(2, fixed.NOTE_DELETED)},"
        f" {large}, {starting(4, fixed.NOTE_CLASSES)}), 1, {fixed.MAX_KEY_CHANGES})"
    )


def _recommendations() -> Column:
    rules = [
        ("n_high > 0", f"format_string('{fixed.ADVICE_HIGH}', n_high)"),
        ("n_other > 2 * n_test", sql_text(fixed.ADVICE_TESTS)),
        ("first_feature IS NOT NULL AND first_doc IS NULL", sql_text(fixed.ADVICE_DOCS)),
        ("any_api", sql_text(fixed.ADVICE_API)),
        (f"total_lines_added + total_lines_removed > {fixed.LARGE_CHANGE_SET_OVER}", sql_text(fixed.ADVICE_SIZE)),
        ("any_import", sql_text(fixed.ADVICE_IMPORTS)),
    ]
    texts = ", ".join(f"CASE WHEN {condition} THEN {text} END" for condition, text in rules)
    return F.expr(f"slice(array_compact(array({texts})), 1, {fixed.MAX_RECOMMENDATIONS})")


STAT_NAMES = [
    "total_files",
    "files_added",
    "files_modified",
    "files_deleted",
    "total_lines_added",
    "total_lines_removed",
]

IS_MISSING = (
    "(lines_added IS NULL OR lines_removed IS NULL OR complexity_score IS NULL OR impact_assessment IS NULL)"
)

# What the roll-up needs to know of one file; false where there is no file.
_FLAGS = {
    "is_added": "change_type = 'added'",
    "is_modified": "change_type = 'modified'",
    "is_deleted": "change_type = 'deleted'",
    "is_high": f"complexity_score >= {fixed.SCORE_HIGH}",
    "is_test": "contains(lower(filename), 'test') OR contains(lower(filename), 'spec')",
    "has_doc": "contains(lower(purpose_inference), 'documentation')",
    "has_feature": "contains(lower(purpose_inference), 'feature addition')",
    "has_no_purpose": "purpose_inference IS NULL",
    "has_api": "contains(lower(impact_assessment), 'public api')",
    "has_import": "exists(elements, e -> contains(e.change_type, 'import'))",
    "has_missing": IS_MISSING,
}

# One chunk's numbers, over rows whose filename is NULL when there is no file.
_PER_CHUNK = {
    "parsed_files": "count(file_seq)",
    "total_files": "count(filename)",
    "files_added": "count_if(is_added)",
    "files_modified": "count_if(is_modified)",
    "files_deleted": "count_if(is_deleted)",
    "total_lines_added": "coalesce(sum(CASE WHEN filename IS NOT NULL THEN lines_added END), 0L)",
    "total_lines_removed": "coalesce(sum(CASE WHEN filename IS NOT NULL THEN lines_removed END), 0L)",
    "n_high": "count_if(is_high)",
    "n_test": "count_if(is_test)",
    "n_other": "count_if(filename IS NOT NULL AND NOT is_test)",
    "first_doc": "min(CASE WHEN has_doc THEN file_seq END)",
    "first_feature": "min(CASE WHEN has_feature THEN file_seq END)",
    "first_null_purpose": "min(CASE WHEN has_no_purpose THEN file_seq END)",
    "any_api": "bool_or(has_api)",
    "any_import": "bool_or(has_import)",
    "any_missing": "bool_or(has_missing)",
}


def _merge(name: str) -> str:
    return {"first": "min", "any": "bool_or"}.get(name.split("_")[0], "sum") + f"({name})"


def _rollup(files: DataFrame, keys: Sequence[str], known_purposes: bool, with_files: bool) -> DataFrame:
    """Counters, flags and short lists of each change set, chunk by chunk."""
    lists = {"noted": _first_noted("noted")}
    flags = {
        name: F.expr(f"coalesce(filename IS NOT NULL AND ({condition}), false)")
        for name, condition in _FLAGS.items()
    }
    texts = ["summary", "file_key_changes"] if with_files else []
    noted = fixed_columns(
        files,
        [*keys, "file_seq", "filename", "lines_added", "lines_removed", *texts],
        **flags,
        noted=F.when(F.col("filename").isNotNull(), _noted()),
        counted=_purpose_entries() if known_purposes else _purpose_entries(OPEN_PURPOSES),
    )
    lists["counted"] = _counted_purposes("counted")

    def shortened(grouped: DataFrame, kept: Sequence[str]) -> DataFrame:
        rest = [c for c in grouped.columns if c not in lists and c not in kept]
        return grouped.select(*kept, *rest, *[value.alias(name) for name, value in lists.items()])

    per_chunk = [F.expr(f"{value} AS {name}") for name, value in _PER_CHUNK.items()]
    collected = [F.expr(f"array_sort(flatten(collect_list({name}))) AS {name}") for name in lists]
    file_list = []
    if with_files:
        file_list = [
            F.expr(
                "collect_list(CASE WHEN filename IS NOT NULL THEN"
                " struct(file_seq, filename, summary, file_key_changes) END) AS file_list"
            )
        ]
    chunk = F.expr(f"coalesce(floor(file_seq / {CHUNK}), 0L) AS chunk")
    chunks = shortened(
        noted.groupBy(*keys, chunk).agg(*per_chunk, *collected, *file_list), [*keys, "chunk"]
    )
    merged = [F.expr(f"{_merge(name)} AS {name}") for name in _PER_CHUNK]
    if with_files:
        file_list = [F.expr("array_sort(flatten(collect_list(file_list))) AS file_list")]
    if known_purposes:
        whole = shortened(chunks.groupBy(*keys).agg(*merged, *collected, *file_list), keys)
        top = f"transform(slice(array_sort(counted), 1, {fixed.TOP_PURPOSES}), x -> x.purpose)"
        return whole.withColumn("top", F.expr(top)).drop("counted")
    # Any purpose text: each chunk gives one row of its counters and one row per
    # purpose with its exact count; one aggregation merges both kinds by change
    # set (and purpose), so the scan, parsing and analysis run once.
    rest = [c for c in chunks.columns if c not in (*keys, "chunk", "counted")]
    first_type = chunks.schema["counted"].dataType.elementType["first"].dataType
    typed = lambda name: F.lit(None).cast(chunks.schema[name].dataType).alias(name)
    base = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("purpose"),
                    F.lit(None).cast("bigint").alias("n"), F.lit(None).cast(first_type).alias("first"),
                    *[F.col(c) for c in rest])
    each = F.transform("counted", lambda e: F.struct(F.lit(1).alias("kind"), e["purpose"].alias("purpose"),
                                                     e["n"].alias("n"), e["first"].alias("first"),
                                                     *[typed(c) for c in rest]))
    rows = chunks.select(*keys, F.explode(F.concat(F.array(base), each)).alias("r")).select(*keys, "r.*")
    grouped = rows.groupBy(*keys, "kind", "purpose").agg(
        *merged, collected[0], *file_list, F.sum("n").alias("n"), F.min("first").alias("first"))
    order = Window.partitionBy(*keys).orderBy("kind", "n", "first")
    ranked = grouped.withColumn("rank", F.row_number().over(order)).where(
        (F.col("kind") == 0) | (F.col("rank") <= fixed.TOP_PURPOSES + 1))
    own = [c for c in grouped.columns if c not in (*keys, "kind", "purpose", "n", "first")]
    whole = ranked.groupBy(*keys).agg(
        *[F.first(F.when(F.col("kind") == 0, F.col(c)), ignorenulls=True).alias(c) for c in own],
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("rank", "purpose")))).alias("ranked"))
    del lists["counted"]
    whole = shortened(whole, keys)
    return whole.withColumn("top", F.transform("ranked", lambda x: x["purpose"])).drop("ranked")


def _report(rolled: DataFrame, keys: Sequence[str], with_files: bool) -> DataFrame:
    empty = F.col("total_files") == 0
    # A missing purpose spoils the roll-up unless both searches through the
    # purposes had already stopped at an earlier file.
    far = (1 << 63) - 1
    rolled = rolled.withColumn("failed", F.expr(
        "coalesce(any_missing, false)"
        f" OR coalesce(first_null_purpose < coalesce(first_doc, {far}), false)"
        f" OR coalesce(first_null_purpose < coalesce(first_feature, {far}), false)"
    ))
    failed = F.col("failed")
    none = F.array().cast(STRINGS)
    zeroed = lambda name: f"'{name}', CASE WHEN failed THEN 0L ELSE {name} END"
    columns = [
        F.when(empty, fixed.NO_CHANGES)
        .when(failed, fixed.ROLLUP_FAILED)
        .otherwise(overview_text())
        .alias("overview"),
        F.expr(
            f"named_struct({', '.join(zeroed(name) for name in STAT_NAMES)}) AS statistics"
        ),
        F.when(empty | failed, none).otherwise(_key_changes()).alias("key_changes"),
        F.when(empty, none)
        .when(failed, F.array(F.lit(fixed.ROLLUP_FAILED_ADVICE)))
        .otherwise(_recommendations())
        .alias("recommendations"),
        F.col("parsed_files"),
    ]
    if with_files:
        listed = F.expr(
            "transform(file_list, f -> named_struct('filename', f.filename, 'summary', f.summary,"
            " 'key_changes', f.file_key_changes))"
        )
        columns.insert(
            2, F.when(failed, F.slice(listed, 1, 0)).otherwise(listed).alias("file_summaries")
        )
    return rolled.select(*keys, *columns)


def summarize(
    analysis: DataFrame,
    keys: Sequence[str] = DIFF_ID,
    known_purposes: bool = False,
    with_files: bool = True,
) -> DataFrame:
    """One row per change set: overview, statistics, key changes, recommendations.

    A change set whose rows name no file reports "No changes detected".

    ``with_files`` also puts every file's summary into one array per change
    set; leave it off for change sets too large for one row and read
    ``file_summaries`` instead.  ``known_purposes`` counts the ``purposes``
    lists within the same pass; it is meant for rows made by ``analyze_files``,
    whose few distinct purposes come from a closed list.  Otherwise
    ``purpose_inference`` is split and counted by ``top_purposes``, which takes
    any number of distinct texts.
    """
    is_file = F.col("file_seq").isNotNull() & (F.col("filename") != "")
    elements = F.coalesce("elements", F.array().cast(_elements_type(analysis)))
    files = analysis.withColumn("filename", F.when(is_file, F.col("filename"))).withColumn(
        "elements", elements
    )
    if with_files:
        files = _with_summary(files)
    rolled = _rollup(files, keys, known_purposes, with_files)
    return _report(rolled, keys, with_files)


def _with_summary(files: DataFrame) -> DataFrame:
    return files.select(
        "*",
        F.when(F.col("filename").isNotNull(), change_description()).alias("summary"),
        F.when(F.col("filename").isNotNull(), file_key_changes()).alias("file_key_changes"),
    )
