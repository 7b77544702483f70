"""The registered queries and, for each, the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import fixed_values as fixed
from patchloom.functions.language import detect_language
from patchloom.functions.text import is_blank, lines_text, looks_like_diff
from patchloom.operators import analysis, elements, parse, render, summary
from patchloom.plans import reports
from patchloom.sources.patch_files import (
    PATH,
    read_patch_files,
    SECTION_KEYS,
    number_files,
    read_patch_sections,
    write_rendered,
    write_reports,
)
from workload import oracle
from workload.corpus import diffs

Query = Callable[[SparkSession, str], DataFrame]

TEMPLATE = (
    "{{report}} {overview}\n{total_files}/{files_added}/{files_modified}/{files_deleted}"
    " +{lines_added} -{lines_removed}\n{key_changes}\n{recommendations}\n{file_summaries}"
)
NAMED_TEMPLATES = {"short": "{overview} [{total_files}]", "notes": "{key_changes}\n--\n{recommendations}"}


OWN_EXTENSIONS = {".xyz": "notes", ".txt": "notes"}
OWN_PATTERNS = {"notes": {"asyncfunction": r"^\s*value\s*=\s*(\w+)", "dataclass": r"^\s*#\s*(\w+)\s+note"}}
# Change set ids per patch file.
BUNDLE = 200
# Analysed rows that lack a value, as other sources of such rows may leave them.
BLANKED = {
    "lines_added": "diff_id % 3 = 0 AND file_seq % 5 = 3",
    "complexity_score": "diff_id % 7 = 1",
    "impact_assessment": "diff_id % 11 = 2 AND file_seq = 1",
    "purpose_inference": "diff_id % 3 = 1 AND file_seq % 4 = 2",
}


def _joined(*names: str) -> list[Column]:
    return [F.array_join(name, "\n").alias(name) for name in names]


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("diff_text")
    return diffs(spark, sf_dir).select(
        "diff_id", is_blank(text).alias("blank"), looks_like_diff(text).alias("looks_like_diff")
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_files(diffs(spark, sf_dir)).drop("added_lines", "removed_lines")


def _unreadable_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parse.parse_files(diffs(spark, sf_dir))
    return files.where((F.col("filename") == "unknown") | (F.col("filename") == "")).select(
        "diff_id", "file_seq", "filename", "change_type", "lines_added", "lines_removed"
    )


def _fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs(spark, sf_dir).select(
        F.col("diff_id").alias("fragment_id"), F.col("diff_text").alias("text")
    )


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parse.parse_files(diffs(spark, sf_dir))
    return files.select(
        "diff_id", "file_seq", "filename", detect_language(F.col("filename")).alias("language")
    )


def _code_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = parse.parse_files(diffs(spark, sf_dir)).where("filename <> ''")
    code = files.select(
        "diff_id",
        "file_seq",
        detect_language(F.col("filename")).alias("language"),
        lines_text(F.col("added_lines")).alias("code"),
    )
    found = elements.code_elements(code, keys=("diff_id", "file_seq"))
    return found.withColumn("type_ord", F.col("type_ord").cast("bigint")).withColumn(
        "line", F.col("line").cast("bigint")
    )


def _element_rows(verb: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = elements.element_rows(reports.analyze_diffs(diffs(spark, sf_dir)))
        return rows if verb is None else rows.where(F.endswith("change_type", F.lit("_" + verb)))

    return query


def _structural_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = reports.analyze_diffs(diffs(spark, sf_dir))
    return analysed.select(
        "diff_id",
        "file_seq",
        F.array_join(F.transform("elements", lambda e: e["description"]), "\n").alias("elements"),
    )


def _analysis(*columns: str, compat: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        analysed = reports.analyze_diffs(diffs(spark, sf_dir), compat=compat)
        return analysed.withColumn(
            "complexity_score", F.col("complexity_score").cast("bigint")
        ).select("diff_id", "file_seq", *columns)

    return query


ANALYSIS = [
    "filename",
    "change_type",
    "old_filename",
    "language",
    "lines_added",
    "lines_removed",
    "purpose_inference",
    "impact_assessment",
    "complexity_score",
    "status",
]


def _file_summaries(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = summary.file_summaries(reports.analyze_diffs(diffs(spark, sf_dir)))
        picked = _joined("key_changes") if "key_changes" in columns else []
        plain = [c for c in columns if c != "key_changes"]
        return rows.select("diff_id", "file_seq", "filename", *plain, *picked)

    return query


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diff_statistics(diffs(spark, sf_dir))


def _top_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_purposes(reports.analyze_diffs(diffs(spark, sf_dir)))


def _headers(*columns: str) -> Query:
    """Parts of the change-set report that need no list of all files."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reports.summarize_diffs(diffs(spark, sf_dir), with_files=False)
        lists = [c for c in columns if c in ("key_changes", "recommendations")]
        return rows.select("diff_id", *[c for c in columns if c not in lists], *_joined(*lists))

    return query


def _summaries(compat: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reports.summarize_diffs(diffs(spark, sf_dir), compat=compat)
        return rows.select(
            "diff_id",
            "overview",
            "statistics.*",
            *_joined("key_changes", "recommendations"),
            render.template_file_block().alias("file_summaries"),
            "parsed_files",
        )

    return query


def _open_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up for analysed rows of any origin: purposes are free text."""
    analysed = reports.analyze_diffs(diffs(spark, sf_dir)).drop("purposes", "impacts", "status")
    rows = summary.summarize(analysed)
    return rows.select("diff_id", "overview", *_joined("key_changes", "recommendations"))


def _rendered(format_name: str = "plain", **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.render_diffs(diffs(spark, sf_dir), format_name, **options)

    return query


def _file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.summarize_diffs(diffs(spark, sf_dir))
    block = render.template_file_block()
    return rows.select("diff_id", block.alias("file_summaries"))


def _by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.summarize_diffs(diffs(spark, sf_dir))
    name = F.when(F.col("diff_id") % 2 == 0, "MD").otherwise("text")
    return render.render_by_column(rows.withColumn("format", name))


def _parts(spark: SparkSession, sf_dir: str, format_name: str = "plain") -> DataFrame:
    files = parse.parse_files(diffs(spark, sf_dir), keep_empty=True)
    analysed = analysis.analyze_files(files, keep_empty=True)
    headers = summary.summarize(analysed, known_purposes=True, with_files=False)
    return render.render_parts(headers, summary.file_summaries(analysed), format_name)


def _scratch(spark: SparkSession) -> str:
    """A new folder in the place the cluster shares, else in the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def _patch_folder(spark: SparkSession, sf_dir: str) -> str:
    """File sections written as patch files by the text sink: one per ``BUNDLE`` change set ids, in order."""
    sections = parse.file_sections(diffs(spark, sf_dir))
    sections = sections.withColumn("bundle", F.expr(f"diff_id div {BUNDLE}"))
    placed = sections.repartition("bundle").sortWithinPartitions("bundle", "diff_id", "file_seq")
    folder = _scratch(spark) + "/patches"
    write_rendered(placed.withColumnRenamed("section", "rendered"), folder, by=["bundle"])
    return folder


FILE_COLUMNS = ["filename", "change_type", "old_filename", "lines_added", "lines_removed"]


def _from_bundles(files: DataFrame) -> DataFrame:
    bundle = F.regexp_extract("path", "bundle=([0-9]+)", 1).cast("bigint").alias("bundle")
    return files.select(bundle, "file_seq", *FILE_COLUMNS)


def _patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = read_patch_files(spark, _patch_folder(spark, sf_dir))
    return _from_bundles(parse.parse_files(patches, PATH))


def _patch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = read_patch_sections(spark, _patch_folder(spark, sf_dir))
    files = parse.files_from_sections(sections, SECTION_KEYS).drop("added_lines", "removed_lines")
    return _from_bundles(number_files(files, PATH))


def _stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written with their keys and read back."""
    folder = _scratch(spark) + "/reports"
    write_reports(reports.render_diffs(diffs(spark, sf_dir), "plain"), folder)
    return spark.read.schema("diff_id bigint, rendered string").parquet(folder)


def _own_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis with a language, extensions and patterns of the caller's own."""
    patterns = fixed.ELEMENT_PATTERNS | OWN_PATTERNS
    rows = reports.analyze_diffs(diffs(spark, sf_dir), patterns=patterns, extensions=OWN_EXTENSIONS)
    score = F.col("complexity_score").cast("bigint").alias("complexity_score")
    return rows.select("diff_id", "file_seq", "language", "purpose_inference", "impact_assessment", score)


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.analyze_diffs(diffs(spark, sf_dir)).drop("purposes", "impacts", "status")
    emptied = {name: F.expr(f"CASE WHEN NOT ({condition}) THEN {name} END") for name, condition in BLANKED.items()}
    return rows.withColumns(emptied)


def _fallback_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.summarize(_blanked(spark, sf_dir))
    block = render.template_file_block().alias("file_summaries")
    return rows.select("diff_id", "overview", "statistics.*", *_joined("key_changes", "recommendations"), block)


def _fallback_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.file_summaries(_blanked(spark, sf_dir))
    return rows.select("diff_id", "file_seq", "filename", "summary", *_joined("key_changes"))


def queries() -> dict[str, Query]:
    return {
        "statistics": _statistics,
        "diff_validation": _validation,
        "files": _files,
        "hunks": lambda s, d: parse.parse_hunks(diffs(s, d)),
        "diff_lines": lambda s, d: parse.parse_lines(diffs(s, d)).drop("line_number"),
        "line_numbers": lambda s, d: parse.parse_lines(diffs(s, d)).drop("content"),
        "malformed": _unreadable_headers,
        "fragment_hunks": lambda s, d: parse.extract_hunks(_fragment(s, d)),
        "fragment_lines": lambda s, d: parse.extract_lines(_fragment(s, d)),
        "languages": _languages,
        "code_elements": _code_elements,
        "elements_added": _element_rows("added"),
        "elements_removed": _element_rows("removed"),
        "elements_modified": _element_rows("modified"),
        "elements": _element_rows(),
        "structural_list": _structural_lists,
        "purposes": _analysis("purpose_inference"),
        "impacts": _analysis("impact_assessment"),
        "complexity": _analysis("complexity_score"),
        "file_analysis": _analysis(*ANALYSIS),
        "file_analysis_compat": _analysis(*ANALYSIS, compat=True),
        "file_descriptions": _file_summaries("summary"),
        "file_key_changes": _file_summaries("key_changes"),
        "file_summaries": _file_summaries("summary", "key_changes"),
        "top_purposes": _top_purposes,
        "overview": _headers("overview"),
        "key_changes": _headers("key_changes"),
        "recommendations": _headers("recommendations"),
        "summaries": _summaries(),
        "summaries_compat": _summaries(compat=True),
        "summaries_any_purpose": _open_summaries,
        "render_json": _rendered("json"),
        "render_markdown": _rendered("markdown"),
        "render_plain": _rendered("plain"),
        "render_template": _rendered(template=TEMPLATE),
        "render_named_template": _rendered(template_name="notes", templates=NAMED_TEMPLATES),
        "render_by_column": _by_column,
        "render_parts": _parts,
        "render_json_parts": lambda s, d: _parts(s, d, "json"),
        "template_file_block": _file_blocks,
        "patch_files": _patch_files,
        "patch_sections": _patch_sections,
        "stored_reports": _stored_reports,
        "own_language": _own_language,
        "fallback_summaries": _fallback_summaries,
        "fallback_files": _fallback_files,
    }


# --- the checking SQL -------------------------------------------------------

_NL = oracle.NL
_TEXT_LISTS = (
    f"array_to_string(key_changes, {_NL}) AS key_changes,"
    f" array_to_string(recommendations, {_NL}) AS recommendations"
)
_COUNTERS = "total_files, files_added, files_modified, files_deleted, total_lines_added, total_lines_removed"


def _fragment_sql(select: str) -> str:
    """The same parse with everything in one section: only ``@@`` starts count."""
    return f"""WITH {oracle._corpus()}, cut AS (SELECT diff_id, string_split(diff_text, {_NL}) AS l FROM diffs),
numbered AS (SELECT diff_id, unnest(l) AS line, generate_subscripts(l, 1)::BIGINT AS pos FROM cut),
opened AS (SELECT *, sum(CASE WHEN starts_with(line, '@@') OR starts_with(line, 'diff --git') THEN 1 ELSE 0 END)
  OVER (PARTITION BY diff_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM numbered),
heads AS (SELECT diff_id, part, row_number() OVER (PARTITION BY diff_id ORDER BY part)::BIGINT AS hunk_seq,
    regexp_extract(line, {oracle.q(oracle.HUNK)}, 1)::BIGINT AS old_start, {oracle._count_of(2)} AS old_count,
    regexp_extract(line, {oracle.q(oracle.HUNK)}, 3)::BIGINT AS new_start, {oracle._count_of(4)} AS new_count,
    {oracle._strip(f"regexp_extract(line, {oracle.q(oracle.HUNK)}, 5)")} AS context
  FROM opened WHERE starts_with(line, '@@') AND regexp_matches(line, {oracle.q(oracle.HUNK)})),
body AS (SELECT o.diff_id AS fragment_id, h.hunk_seq, h.old_start, h.new_start,
    row_number() OVER (PARTITION BY o.diff_id, o.part ORDER BY o.pos)::BIGINT AS line_seq,
    CASE WHEN o.line[1] IN ('+', '-') THEN o.line[1] ELSE ' ' END AS line_type,
    CASE WHEN o.line[1] IN ('+', '-', ' ') THEN o.line[2:] ELSE o.line END AS content
  FROM opened o JOIN heads h USING (diff_id, part) WHERE NOT starts_with(o.line, '@@'))
{select}"""


def _elements_sql(condition: str = "true") -> str:
    return oracle.through("elements") + (
        f"SELECT {oracle.ELEMENT_COLUMNS} FROM elements WHERE {condition}"
    )


def _analysis_sql(*columns: str, compat: bool = False) -> str:
    return oracle.through("analysis", compat) + (
        f"SELECT diff_id, file_seq, {', '.join(columns)} FROM analysis"
    )


def _summary_sql(select: str, compat: bool = False) -> str:
    return oracle.through("summary", compat) + select


def _json_text(value: str) -> str:
    return f"""('"' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"')"""


def _json_listed(items: str, pad: int) -> str:
    gap = f"{_NL} || '{' ' * (pad + 2)}'"
    strings = f"list_transform({items}, lambda x: {_json_text('x')})"
    return (
        f"CASE WHEN len({items}) = 0 THEN '[]' ELSE '[' || {gap} || array_to_string({strings}, ',' || {gap})"
        f" || {_NL} || '{' ' * pad}]' END"
    )


def _json_entry(f: str) -> str:
    return (
        f"""'    ' || chr(123) || {_NL} || '      "filename": ' || {_json_text(f"{f}filename")} || ',' || {_NL}"""
        f""" || '      "summary": ' || {_json_text(f"{f}summary")} || ',' || {_NL}"""
        f""" || '      "key_changes": ' || {_json_listed(f"{f}key_changes", 6)} || {_NL} || '    ' || chr(125)"""
    )


def _json_text_of_summaries() -> str:
    listed = _json_listed
    counters = f" || ',' || {_NL} || ".join(f"""'    "{n}": ' || {n}""" for n in _COUNTERS.split(", "))
    entry = _json_entry("f.")
    files = (
        f"CASE WHEN len(file_summaries) = 0 THEN '[]' ELSE '[' || {_NL} || array_to_string("
        f"list_transform(file_summaries, lambda f: {entry}), ',' || {_NL}) || {_NL} || '  ]' END"
    )
    text = (
        f"""chr(123) || {_NL} || '  "overview": ' || {_json_text("overview")} || ',' || {_NL}"""
        f""" || '  "statistics": ' || chr(123) || {_NL} || {counters} || {_NL} || '  ' || chr(125) || ',' || {_NL}"""
        f""" || '  "file_summaries": ' || {files} || ',' || {_NL}"""
        f""" || '  "key_changes": ' || {listed("key_changes", 2)} || ',' || {_NL}"""
        f""" || '  "recommendations": ' || {listed("recommendations", 2)} || {_NL} || chr(125)"""
    )
    return text


def _json_sql() -> str:
    return _summary_sql(f"SELECT diff_id, {_json_text_of_summaries()} AS rendered FROM summaries")


def _json_parts_sql() -> str:
    """Cut the whole JSON where its file list opens and closes; one piece per listed file between."""
    opening = """'"file_summaries": ['"""
    closing = f"""{_NL} || '  ],' || {_NL} || '  "key_changes"'"""
    whole = f"SELECT diff_id, file_summaries, {_json_text_of_summaries()} AS text FROM summaries"
    return _summary_sql(
        f"""SELECT diff_id, 0::BIGINT AS part, CASE WHEN len(file_summaries) > 0
    THEN split_part(text, {opening}, 1) || {opening} ELSE text END AS text FROM ({whole})
UNION ALL SELECT f.diff_id, f.file_seq, {_json_entry("f.")}
    || CASE WHEN f.file_seq < max(f.file_seq) OVER (PARTITION BY f.diff_id) THEN ',' ELSE '' END
  FROM file_summaries f JOIN summaries s ON s.diff_id = f.diff_id WHERE len(s.file_summaries) > 0
UNION ALL SELECT diff_id, 9223372036854775807, '  ]' || ',' || {_NL} || '  "key_changes"' || split_part(text, {closing}, 2)
  FROM ({whole}) WHERE len(file_summaries) > 0"""
    )


def _parts_sql() -> str:
    """Cut the whole plain text where each file's block starts and ends."""
    head = f"CASE WHEN total_files > 0 THEN split_part(text, {_NL} || 'File: ', 1) ELSE text END"
    tail = f"{_NL} || 'RECOMMENDATIONS:' || {_NL}"
    block = oracle._lines(
        "'File: ' || filename",
        "'Summary: ' || summary",
        f"CASE WHEN len(key_changes) > 0 THEN {oracle._lines(repr('Key changes:'), oracle._bullets('key_changes', '  - '))} END",
        "''",
    )
    return _summary_sql(
        f"""SELECT diff_id, 0::BIGINT AS part, {head} AS text FROM (SELECT diff_id, total_files, {oracle.plain()} AS text FROM summaries)
UNION ALL SELECT diff_id, file_seq, {block} FROM file_summaries
UNION ALL SELECT diff_id, 9223372036854775807, 'RECOMMENDATIONS:' || {_NL} || split_part(text, {tail}, 2)
  FROM (SELECT diff_id, recommendations, {oracle.plain()} AS text FROM summaries) WHERE len(recommendations) > 0"""
    )


def _template_sql() -> str:
    text = (
        f"chr(123) || 'report' || chr(125) || ' ' || overview || {_NL} || total_files || '/' || files_added || '/' ||"
        f" files_modified || '/' || files_deleted || ' +' || total_lines_added || ' -' || total_lines_removed || {_NL} ||"
        f" {oracle._bullets('key_changes')} || {_NL} || {oracle._bullets('recommendations')} || {_NL} || {oracle.file_block()}"
    )
    return _summary_sql(f"SELECT diff_id, {text} AS rendered FROM summaries")


def _summaries_sql(compat: bool = False) -> str:
    return _summary_sql(
        f"SELECT diff_id, overview, {_COUNTERS}, {_TEXT_LISTS}, {oracle.file_block()} AS file_summaries, parsed_files FROM summaries",
        compat,
    )


def _bundles_sql() -> str:
    columns = ", ".join(FILE_COLUMNS)
    return oracle.through("parse") + (
        f"SELECT diff_id // {BUNDLE} AS bundle, row_number() OVER (PARTITION BY diff_id // {BUNDLE}"
        f" ORDER BY diff_id, file_seq)::BIGINT AS file_seq, {columns} FROM files"
    )


def _blanked_sql(select: str) -> str:
    emptied = ", ".join(f"CASE WHEN NOT ({condition}) THEN {name} END AS {name}" for name, condition in BLANKED.items())
    missing = " OR ".join(f"{name} IS NULL" for name in ("lines_added", "lines_removed", "complexity_score", "impact_assessment"))
    first_of = lambda text: f"coalesce(min(file_seq) FILTER (contains(lower(purpose_inference), '{text}')), 1e18)"
    return oracle.through("summary", blanked=emptied) + f""", spoiled AS (
  SELECT diff_id, bool_or({missing}) OR coalesce(min(file_seq) FILTER (purpose_inference IS NULL)
      < greatest({first_of("documentation")}, {first_of("feature addition")}), false) AS failed
  FROM analysis GROUP BY diff_id
), unfit AS (SELECT diff_id, file_seq, {missing} AS failed FROM analysis)
{select}"""


def _fallback_sql() -> str:
    counters = ", ".join(f"CASE WHEN failed THEN 0 ELSE {name} END AS {name}" for name in _COUNTERS.split(", "))
    return _blanked_sql(
        f"""SELECT diff_id, CASE WHEN failed THEN {oracle.q(fixed.ROLLUP_FAILED)} ELSE overview END AS overview, {counters},
          CASE WHEN failed THEN '' ELSE array_to_string(key_changes, {_NL}) END AS key_changes,
          CASE WHEN failed THEN {oracle.q(fixed.ROLLUP_FAILED_ADVICE)} ELSE array_to_string(recommendations, {_NL}) END AS recommendations,
          CASE WHEN failed THEN 'No file changes' ELSE {oracle.file_block()} END AS file_summaries
        FROM summaries JOIN spoiled USING (diff_id)"""
    )


def oracle_sql() -> dict[str, str]:
    parse_sql = lambda select: oracle.through("parse") + select
    listed = f"array_to_string(key_changes, {_NL}) AS key_changes"
    return {
        "statistics": parse_sql(
            """SELECT d.diff_id, count(filename) AS total_files, count(*) FILTER (change_type = 'added') AS files_added,
            count(*) FILTER (change_type = 'modified') AS files_modified, count(*) FILTER (change_type = 'deleted') AS files_deleted,
            coalesce(sum(lines_added), 0)::BIGINT AS total_lines_added, coalesce(sum(lines_removed), 0)::BIGINT AS total_lines_removed
            FROM diffs d LEFT JOIN (SELECT * FROM files WHERE filename <> '') f USING (diff_id) GROUP BY d.diff_id"""
        ),
        "diff_validation": oracle.through("diffs")
        + f"""SELECT diff_id, NOT regexp_matches(diff_text, '[^{oracle.BLANK[1:-1]}]') AS blank,
            contains(diff_text, 'diff --git') OR (contains(diff_text, '---') AND contains(diff_text, '+++') AND contains(diff_text, '@@'))
              AS looks_like_diff FROM diffs""",
        "files": parse_sql("SELECT * FROM files"),
        "hunks": parse_sql(
            "SELECT diff_id, file_seq, hunk_seq, old_start, old_count, new_start, new_count, context FROM hunks"
        ),
        "diff_lines": parse_sql("SELECT diff_id, file_seq, hunk_seq, line_seq, line_type, content FROM lines"),
        "line_numbers": parse_sql("SELECT diff_id, file_seq, hunk_seq, line_seq, line_type, line_number FROM lines"),
        "malformed": parse_sql(
            "SELECT diff_id, file_seq, filename, change_type, lines_added, lines_removed FROM files WHERE filename IN ('', 'unknown')"
        ),
        "fragment_hunks": _fragment_sql(
            "SELECT diff_id AS fragment_id, hunk_seq, old_start, old_count, new_start, new_count, context FROM heads"
        ),
        "fragment_lines": _fragment_sql(
            """SELECT fragment_id, hunk_seq, line_seq, line_type, content, CASE WHEN line_type = '+'
              THEN new_start + coalesce(count(*) FILTER (line_type <> '-') OVER w, 0)
              ELSE old_start + coalesce(count(*) FILTER (line_type <> '+') OVER w, 0) END AS line_number FROM body
              WINDOW w AS (PARTITION BY fragment_id, hunk_seq ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
        ),
        "languages": oracle.through("languages") + "SELECT diff_id, file_seq, filename, language FROM tagged",
        "code_elements": oracle.through("elements")
        + """SELECT diff_id, file_seq, type_ord::BIGINT AS type_ord, element_type, name, line_ord::BIGINT AS line, content, parameters
            FROM found WHERE line_type = '+'""",
        "elements_added": _elements_sql("verb = 'added'"),
        "elements_removed": _elements_sql("verb = 'removed'"),
        "elements_modified": _elements_sql("verb = 'modified'"),
        "elements": _elements_sql(),
        "structural_list": oracle.through("elements")
        + f"""SELECT t.diff_id, t.file_seq, coalesce(string_agg(description, {_NL} ORDER BY element_seq), '') AS elements
            FROM tagged t LEFT JOIN (SELECT {oracle.ELEMENT_COLUMNS} FROM elements) e USING (diff_id, file_seq)
            WHERE filename <> '' GROUP BY ALL""",
        "purposes": _analysis_sql("purpose_inference"),
        "impacts": _analysis_sql("impact_assessment"),
        "complexity": _analysis_sql("complexity_score"),
        "file_analysis": _analysis_sql(*ANALYSIS),
        "file_analysis_compat": _analysis_sql(*ANALYSIS, compat=True),
        "file_descriptions": _summary_sql("SELECT diff_id, file_seq, filename, summary FROM file_summaries"),
        "file_key_changes": _summary_sql(f"SELECT diff_id, file_seq, filename, {listed} FROM file_summaries"),
        "file_summaries": _summary_sql(f"SELECT diff_id, file_seq, filename, summary, {listed} FROM file_summaries"),
        "top_purposes": _summary_sql("SELECT diff_id, rank, purpose, n_files FROM ranked"),
        "overview": _summary_sql("SELECT diff_id, overview FROM summaries"),
        "key_changes": _summary_sql(f"SELECT diff_id, {listed} FROM summaries"),
        "recommendations": _summary_sql(
            f"SELECT diff_id, array_to_string(recommendations, {_NL}) AS recommendations FROM summaries"
        ),
        "summaries": _summaries_sql(),
        "summaries_compat": _summaries_sql(compat=True),
        "summaries_any_purpose": _summary_sql(
            f"SELECT diff_id, overview, {_TEXT_LISTS} FROM summaries WHERE total_files > 0"
        ),
        "render_json": _json_sql(),
        "render_markdown": _summary_sql(f"SELECT diff_id, {oracle.markdown()} AS rendered FROM summaries"),
        "render_plain": _summary_sql(f"SELECT diff_id, {oracle.plain()} AS rendered FROM summaries"),
        "render_template": _template_sql(),
        "render_named_template": _summary_sql(
            f"SELECT diff_id, {oracle._bullets('key_changes')} || {_NL} || '--' || {_NL} || {oracle._bullets('recommendations')} AS rendered FROM summaries"
        ),
        "render_by_column": _summary_sql(
            f"""SELECT diff_id, CASE WHEN diff_id % 2 = 0 THEN 'MD' ELSE 'text' END AS format,
            CASE WHEN diff_id % 2 = 0 THEN {oracle.markdown()} ELSE {oracle.plain()} END AS rendered FROM summaries"""
        ),
        "render_parts": _parts_sql(),
        "render_json_parts": _json_parts_sql(),
        "template_file_block": _summary_sql(f"SELECT diff_id, {oracle.file_block()} AS file_summaries FROM summaries"),
        "patch_files": _bundles_sql(),
        "patch_sections": _bundles_sql(),
        "stored_reports": _summary_sql(f"SELECT diff_id, {oracle.plain()} AS rendered FROM summaries"),
        "own_language": oracle.through("analysis", languages=OWN_EXTENSIONS, patterns=OWN_PATTERNS)
        + "SELECT diff_id, file_seq, language, purpose_inference, impact_assessment, complexity_score FROM analysis",
        "fallback_summaries": _fallback_sql(),
        "fallback_files": _blanked_sql(
            f"""SELECT diff_id, file_seq, filename,
              CASE WHEN failed THEN {oracle.q(fixed.FILE_SUMMARY_FAILED)} || filename ELSE summary END AS summary,
              CASE WHEN failed THEN '' ELSE array_to_string(key_changes, {_NL}) END AS key_changes
            FROM file_summaries JOIN unfit USING (diff_id, file_seq)"""
        ),
    }
