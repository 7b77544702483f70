"""The same results in plain SQL for the checking engine.

Written as window and join queries over single lines, unlike the library,
which never leaves the file's row; agreement of the two says something.
"""

from __future__ import annotations

from patchloom import fixed_values as fixed
from patchloom.functions.regex import group_count, spark_pattern
from workload.corpus import CODE_LINES, EXTENSIONS, MORE_EXTENSIONS, NAMELESS_IMPORTS, REPEATS, WHOLE_NAMES

NL = "chr(10)"
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


# --- change sets ------------------------------------------------------------


def _code_text(template: str) -> str:
    return "(" + q(template).replace("{", "' || chr(123) || '").replace("\t", "' || chr(9) || '") + ")"


def _nth(values: list, number: str) -> str:
    listed = ", ".join(q(v) if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{listed}], ({number} % {len(values)} + 1)::INT)"


def _code_list(ext: str) -> str:
    listed = "[" + ", ".join(_code_text(item) for item in CODE_LINES[ext]) + "]"
    if ext in NAMELESS_IMPORTS:
        extra = f"[{_code_text(NAMELESS_IMPORTS[ext])}]"
        listed = f"CASE WHEN d % 3 = 1 THEN list_concat({listed}, {extra}) ELSE {listed} END"
    return listed


def _corpus() -> str:
    cases = " ".join(f"WHEN {q(e)} THEN {_code_list(e)}" for e in CODE_LINES if e != "other")
    with_mark = lambda mark, listed="code": f"list_transform({listed}, lambda c: '{mark}' || c)"
    return f"""
docs AS (
  SELECT doc_id AS d, source, string_split(text, {NL}) AS lines,
         CASE WHEN doc_id % 100 < 40 THEN doc_id // 100 * 100 WHEN doc_id % 100 < 88 THEN doc_id // 4 * 4 ELSE doc_id END AS diff_id,
         CASE WHEN doc_id % 10 = 9 THEN {_nth(MORE_EXTENSIONS, "(doc_id // 10)")} ELSE {_nth(EXTENSIONS, "(doc_id % 10)")} END AS ext,
         CASE WHEN doc_id % 23 = 5 THEN {_nth(REPEATS, "(doc_id // 23)")} ELSE 1 END AS n_code,
         CASE doc_id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS kind
  FROM documents
), named AS (
  SELECT *, CASE WHEN d % 20 = 6 THEN 'README.md' WHEN d % 40 = 18 THEN {_nth(WHOLE_NAMES, "(d // 40)")}
                 ELSE 'src/' || source || '/' || CASE WHEN d % 9 = 0 THEN 'test_f' ELSE 'f' END || d || '.' || ext END AS path,
         CASE ext {cases} ELSE {_code_list("other")} END AS templates
  FROM docs
), numbered_code AS (
  SELECT d, nr, unnest(templates) AS line, generate_subscripts(templates, 1) AS pos
  FROM (SELECT d, templates, unnest(range(n_code)) AS nr FROM named)
), coded AS (
  SELECT n.*, c.code FROM named n JOIN (
    SELECT d, list(replace(line, '<d>', CASE nr WHEN 0 THEN d::VARCHAR ELSE d || '_' || nr END) ORDER BY nr, pos) AS code
    FROM numbered_code GROUP BY d) c USING (d)
), bodies AS (
  SELECT *, CASE WHEN kind = 'renamed' THEN 'old/f' || d || '.' || ext ELSE path END AS old_path,
    CASE
      WHEN kind = 'deleted' OR (kind <> 'added' AND d % 5 = 2) THEN {with_mark("-")}
      WHEN kind <> 'added' AND d % 3 = 0 THEN list_concat({with_mark("-")}, {with_mark("+")})
      WHEN kind <> 'added' AND d % 3 = 1 THEN list_concat({with_mark("-", "code[1:2]")}, {with_mark("+")})
      ELSE {with_mark("+")} END AS code_body,
    list_transform(lines, lambda x, i:
      CASE WHEN i > 1 AND (i - 1) % 12 = 0 THEN
        CASE WHEN d % 11 = 5 AND (i - 1) % 24 = 12 THEN '@@ malformed ' || (i - 1) || {NL}
             ELSE '@@ -' || (99 + i) || ' +' || (199 + i) || ',7 @@ def ctx_' || (i - 1) || ' ' || {NL} END ELSE '' END ||
      CASE WHEN kind = 'added' THEN '+' WHEN kind = 'deleted' THEN '-'
           ELSE list_extract(['+', '-', ' ', '+', '', ' '], ((i - 1 + d) % 6 + 1)::INT) END || x) AS text_body
  FROM coded
), sections AS (
  SELECT d, diff_id,
    CASE WHEN d % 13 = 3 THEN 'diff --git ' || path
         WHEN d % 29 = 7 THEN 'diff --git a/ b/'
         ELSE 'diff --git a/' || old_path || ' b/' || path END || {NL} ||
    CASE kind WHEN 'added' THEN 'new file mode 100644' || {NL} WHEN 'deleted' THEN 'deleted file mode 100644' || {NL}
              WHEN 'renamed' THEN 'rename from ' || old_path || {NL} || 'rename to ' || path || {NL} ELSE '' END ||
    'index 1111111..2222222 100644' || {NL} || '--- a/' || path || {NL} || '+++ b/' || path || {NL} ||
    '@@ -1,' || len(lines) || ' +1,' || len(lines) || ' @@ ctx' || {NL} ||
    array_to_string(code_body, {NL}) || {NL} || array_to_string(text_body, {NL}) ||
    CASE WHEN d % 17 = 9 THEN {NL} || 'deleted file mode 100644' || {NL} || 'rename to elsewhere' ELSE '' END ||
    CASE WHEN d % 8 = 2 THEN {NL} || chr(92) || ' No newline at end of file' ELSE '' END AS section
  FROM bodies
), diffs AS MATERIALIZED (
  SELECT diff_id,
    CASE WHEN diff_id % 6 = 4 THEN 'Subject: change' || {NL} || '@@ -1 +1 @@ stray' || {NL} || '+stray' || {NL} ELSE '' END ||
    string_agg(section, {NL} ORDER BY d) || CASE WHEN diff_id % 5 = 0 THEN {NL} ELSE '' END AS diff_text
  FROM sections GROUP BY diff_id
  UNION ALL
  SELECT 1000000000 + doc_id,
    CASE doc_id % 150 WHEN 0 THEN '' WHEN 50 THEN ' ' || {NL} || chr(9) || {NL}
         ELSE '--- a/f' || doc_id || {NL} || '+++ b/f' || {NL} || '@@ -1 +1 @@' || {NL} || '+x' END
  FROM documents WHERE doc_id % 50 = 0
)"""


HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$"
FILE = r"^diff --git a/(.*?) b/(.*)$"


def _count_of(group: int) -> str:
    return f"CASE WHEN regexp_extract(line, {q(HUNK)}, {group}) = '' THEN 1 ELSE regexp_extract(line, {q(HUNK)}, {group})::BIGINT END"


PARSE = f"""
cut AS (SELECT diff_id, string_split(diff_text, {NL}) AS l FROM diffs),
numbered AS (SELECT diff_id, unnest(l) AS line, generate_subscripts(l, 1)::BIGINT AS pos FROM cut),
in_file AS (
  SELECT *, sum(CASE WHEN starts_with(line, 'diff --git') THEN 1 ELSE 0 END)
    OVER (PARTITION BY diff_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS file_seq FROM numbered
), marked AS MATERIALIZED (
  SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END)
    OVER (PARTITION BY diff_id, file_seq ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS raw_hunk FROM in_file
), hunks AS MATERIALIZED (
  SELECT diff_id, file_seq, raw_hunk,
    row_number() OVER (PARTITION BY diff_id, file_seq ORDER BY raw_hunk)::BIGINT AS hunk_seq,
    regexp_extract(line, {q(HUNK)}, 1)::BIGINT AS old_start, {_count_of(2)} AS old_count,
    regexp_extract(line, {q(HUNK)}, 3)::BIGINT AS new_start, {_count_of(4)} AS new_count,
    {_strip(f"regexp_extract(line, {q(HUNK)}, 5)")} AS context
  FROM marked WHERE file_seq > 0 AND starts_with(line, '@@') AND regexp_matches(line, {q(HUNK)})
), lines AS MATERIALIZED (
  SELECT diff_id, file_seq, hunk_seq, line_seq, line_type, content,
    CASE WHEN line_type = '+' THEN new_start + before_new ELSE old_start + before_old END AS line_number
  FROM (
    SELECT *,
      coalesce(sum(CASE WHEN line_type <> '+' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS before_old,
      coalesce(sum(CASE WHEN line_type <> '-' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS before_new
    FROM (
      SELECT m.diff_id, m.file_seq, h.hunk_seq, h.old_start, h.new_start,
        row_number() OVER (PARTITION BY m.diff_id, m.file_seq, m.raw_hunk ORDER BY m.pos)::BIGINT AS line_seq,
        CASE WHEN m.line[1] IN ('+', '-') THEN m.line[1] ELSE ' ' END AS line_type,
        CASE WHEN m.line[1] IN ('+', '-', ' ') THEN m.line[2:] ELSE m.line END AS content
      FROM marked m JOIN hunks h USING (diff_id, file_seq, raw_hunk)
      WHERE NOT starts_with(m.line, '@@')
    ) WINDOW w AS (PARTITION BY diff_id, file_seq, hunk_seq ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  )
), headers AS (
  SELECT diff_id, file_seq, regexp_matches(line, {q(FILE)}) AS ok,
    regexp_extract(line, {q(FILE)}, 1) AS a, regexp_extract(line, {q(FILE)}, 2) AS b
  FROM marked WHERE file_seq > 0 AND starts_with(line, 'diff --git')
), metadata AS (
  SELECT diff_id, file_seq,
    max_by(line[13:], pos) FILTER (starts_with(line, 'rename from ')) AS renamed_from,
    max_by(line[11:], pos) FILTER (starts_with(line, 'rename to ')) AS renamed_to,
    max_by(CASE WHEN starts_with(line, 'rename from ') THEN 'renamed' WHEN starts_with(line, 'new') THEN 'added' ELSE 'deleted' END, pos)
      FILTER (starts_with(line, 'rename from ') OR starts_with(line, 'new file mode') OR starts_with(line, 'deleted file mode')) AS kind
  FROM marked WHERE file_seq > 0 AND raw_hunk = 0 GROUP BY ALL
), counts AS (
  SELECT diff_id, file_seq, count(*) FILTER (line_type = '+') AS p, count(*) FILTER (line_type = '-') AS m FROM lines GROUP BY ALL
), files AS MATERIALIZED (
  SELECT h.diff_id, h.file_seq,
    coalesce(renamed_to, CASE WHEN ok THEN b ELSE 'unknown' END) AS filename,
    coalesce(kind, CASE WHEN ok AND a <> b THEN 'renamed' ELSE 'modified' END) AS change_type,
    coalesce(renamed_from, CASE WHEN ok AND a <> b THEN a END) AS old_filename,
    coalesce(p, 0) AS lines_added, coalesce(m, 0) AS lines_removed
  FROM headers h JOIN metadata USING (diff_id, file_seq) LEFT JOIN counts USING (diff_id, file_seq)
)"""


def _language(more: dict[str, str]) -> str:
    names = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.LANGUAGE_BY_NAME.items())
    extensions = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in (fixed.LANGUAGE_BY_EXTENSION | more).items())
    return f"""CASE WHEN starts_with(lower(filename), 'readme') THEN 'markdown'
      ELSE coalesce(CASE lower(filename) {names} END,
        CASE WHEN contains(filename, '.') THEN CASE '.' || lower(string_split(filename, '.')[-1]) {extensions} END END, 'unknown') END"""


def _languages(more: dict[str, str]) -> str:
    return f"""
tagged AS MATERIALIZED (SELECT *, {_language(more)} AS language FROM files)"""


_VARIABLE_HEAD = spark_pattern(r"^\s*(?:const|let|var)\s+(\w+)\s*=")


def _matches(language: str, element_type: str, pattern: str, column: str) -> str:
    if (language, element_type) != ("javascript", "variable"):
        return f"regexp_matches({column}, {q(spark_pattern(pattern))})"
    # No lookahead here: the same set of lines said with plain conditions.
    after = lambda text: q(_VARIABLE_HEAD + spark_pattern(text))
    return (
        f"(regexp_matches({column}, {after(chr(92) + 's')}) OR (regexp_matches({column}, {after('[^;]')})"
        f" AND NOT regexp_matches({column}, {after('function')})"
        f" AND NOT regexp_matches({column}, {after(chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's*=>')})))"
    )


def _group(language: str, element_type: str, pattern: str, index: int, column: str) -> str:
    if index > group_count(pattern):
        return "''"
    text = _VARIABLE_HEAD if (language, element_type) == ("javascript", "variable") else spark_pattern(pattern)
    return f"regexp_extract({column}, {q(text)}, {index})"


def _element_union(source: str, column: str, carried: str, more: dict[str, dict[str, str]]) -> str:
    parts = []
    for language, by_type in (fixed.ELEMENT_PATTERNS | more).items():
        for order, (element_type, pattern) in enumerate(by_type.items()):
            group = lambda i: _group(language, element_type, pattern, i, column)  # noqa: E731, B023
            groups = ", ".join(f"nullif({group(i)}, '')" for i in range(1, group_count(pattern) + 1))
            name = f"coalesce({groups}, 'anonymous')" if groups else "'anonymous'"
            parameters = group(2) if element_type == "function" and group_count(pattern) > 1 else "NULL::VARCHAR"
            parts.append(
                f"SELECT {carried}, {order} AS type_ord, {q(element_type)} AS element_type, {name} AS name,"
                f" {group(1)} AS own, {_strip(column)} AS content, {parameters} AS parameters,"
                f" {str(group_count(pattern) == 0).lower()} AS nameless"
                f" FROM {source} WHERE language = {q(language)} AND {_matches(language, element_type, pattern, column)}"
            )
    return "\nUNION ALL ".join(parts)


def _found(more: dict[str, dict[str, str]]) -> str:
    return f"""
changed AS (
  SELECT t.diff_id, t.file_seq, t.language, l.line_type, l.content AS text,
    row_number() OVER (PARTITION BY t.diff_id, t.file_seq, l.line_type ORDER BY l.hunk_seq, l.line_seq) AS line_ord
  FROM lines l JOIN tagged t USING (diff_id, file_seq) WHERE l.line_type <> ' ' AND t.filename <> ''
), found AS MATERIALIZED (
  {_element_union("changed", "text", "diff_id, file_seq, line_type, line_ord", more)}
), modified AS MATERIALIZED (
  SELECT p.diff_id, p.file_seq, p.type_ord, p.element_type, p.own, min(p.line_ord) AS line_ord
  FROM found p JOIN (SELECT DISTINCT diff_id, file_seq, element_type, own FROM found WHERE line_type = '-') m
    USING (diff_id, file_seq, element_type, own)
  WHERE p.line_type = '+' AND own <> '' GROUP BY ALL
), listed AS (
  SELECT f.diff_id, f.file_seq, CASE WHEN line_type = '+' THEN 0 ELSE 1 END AS phase, f.type_ord, f.line_ord, f.element_type, f.name,
    CASE WHEN line_type = '-' THEN f.content END AS before, CASE WHEN line_type = '+' THEN f.content END AS after
  FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM modified m WHERE m.diff_id = f.diff_id AND m.file_seq = f.file_seq
                      AND m.element_type = f.element_type AND m.own = f.name)
  UNION ALL SELECT diff_id, file_seq, 2, type_ord, line_ord, element_type, own, NULL, NULL FROM modified
), all_elements AS (
  SELECT diff_id, file_seq, row_number() OVER (PARTITION BY diff_id, file_seq ORDER BY phase, type_ord, line_ord)::BIGINT AS element_seq,
    element_type, list_extract(['added', 'removed', 'modified'], phase + 1) AS verb, name, before, after
  FROM listed
), failures AS (
  SELECT DISTINCT diff_id, file_seq FROM found WHERE nameless
)"""


def _elements(compat: bool) -> str:
    kept = "WHERE (diff_id, file_seq) NOT IN (SELECT (diff_id, file_seq) FROM failures)" if compat else ""
    return f"""
elements AS MATERIALIZED (
  SELECT diff_id, file_seq, element_seq, element_type, verb, name, element_type || '_' || verb AS change_type, name AS element_name,
    upper(verb[1]) || verb[2:] || ' ' || element_type || '''' AS head, before, after
  FROM (SELECT * FROM all_elements {kept})
)"""


ELEMENT_COLUMNS = (
    "diff_id, file_seq, element_seq, change_type, element_name, "
    "upper(verb[1]) || verb[2:] || ' ' || element_type || ' ''' || name || '''' AS description, before, after"
)


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def _words(text: str, table: dict[str, list[str]]) -> list[str]:
    return [f"CASE WHEN {_has(text, words)} THEN {q(name)} END" for name, words in table.items()]


def _analysis(compat: bool) -> str:
    t = lambda kind: f"(len(list_filter(types, lambda x: contains(x, '{kind}'))) > 0)"
    purposes = ", ".join(
        [
            _case("change_type", fixed.PURPOSE_BY_KIND),
            f"""CASE WHEN {t("function_added")} AND NOT {t("function_removed")} THEN {q(fixed.PURPOSE_FUNCTION_ADDED)}
                WHEN {t("function_removed")} AND NOT {t("function_added")} THEN {q(fixed.PURPOSE_FUNCTION_REMOVED)}
                WHEN {t("function_modified")} THEN {q(fixed.PURPOSE_FUNCTION_MODIFIED)} END""",
            f"""CASE WHEN {t("class_added")} THEN {q(fixed.PURPOSE_CLASS_ADDED)}
                WHEN {t("class_removed")} THEN {q(fixed.PURPOSE_CLASS_REMOVED)}
                WHEN {t("class_modified")} THEN {q(fixed.PURPOSE_CLASS_MODIFIED)} END""",
            f"""CASE WHEN {t("import_added")} THEN {q(fixed.PURPOSE_IMPORT_ADDED)}
                WHEN {t("import_removed")} THEN {q(fixed.PURPOSE_IMPORT_REMOVED)} END""",
            *_words("plus", fixed.PURPOSE_BY_ADDED_WORDS),
            *_words("minus", fixed.PURPOSE_BY_REMOVED_WORDS),
            f"CASE WHEN language IN ('markdown', 'unknown') AND contains(lower(filename), 'readme') THEN {q(fixed.PURPOSE_README)} END",
            *_words("plus", fixed.PURPOSE_BY_COMMENT_MARKS),
        ]
    )
    suffixes = " ".join(
        f"WHEN {' OR '.join(f'ends_with(filename, {q(s)})' for s in ends)} THEN {q(text)}"
        for ends, text in fixed.IMPACT_BY_SUFFIX
    )
    impacts = f"""{_case("change_type", fixed.IMPACT_BY_KIND)},
      CASE WHEN changed > 100 THEN {q(fixed.IMPACT_LARGE)} WHEN changed > 20 THEN {q(fixed.IMPACT_MEDIUM)} ELSE {q(fixed.IMPACT_SMALL)} END,
      CASE WHEN n_elements - n_private > 0 THEN 'Public API changes (' || (n_elements - n_private) || ' elements) - may affect external code' END,
      CASE WHEN n_private > 0 THEN 'Internal implementation changes (' || n_private || ' elements)' END,
      CASE WHEN len(list_filter(types, lambda x: contains(x, 'class'))) > 0 THEN {q(fixed.IMPACT_CLASS)} END,
      CASE WHEN len(list_filter(types, lambda x: contains(x, 'import'))) > 0 THEN {q(fixed.IMPACT_IMPORT)} END,
      CASE {suffixes} END"""
    raw = f"""(CASE WHEN changed > 200 THEN 4 WHEN changed > 100 THEN 3 WHEN changed > 50 THEN 2 WHEN changed > 10 THEN 1 ELSE 0 END
      + least(n_elements, 3)
      + CASE WHEN {" OR ".join(f"list_contains(types, '{k}')" for k in fixed.SCORE_HEAVY_TYPES)} THEN 2 ELSE 0 END + least(n_modified, 2))"""
    score = f"""least(10, CASE WHEN language IN ('cpp', 'rust', 'java') THEN {raw} + 1
      WHEN language IN ('json', 'yaml', 'markdown') THEN greatest(0, {raw} - 1) ELSE {raw} END
      + CASE change_type WHEN 'renamed' THEN 1 WHEN 'deleted' THEN 2 ELSE 0 END)"""
    failed = "(diff_id, file_seq) IN (SELECT (diff_id, file_seq) FROM failures)" if compat else "false"
    return f"""
sides AS (
  SELECT diff_id, file_seq,
    string_agg(lower(content), {NL} ORDER BY hunk_seq, line_seq) FILTER (line_type = '+') AS plus,
    string_agg(lower(content), {NL} ORDER BY hunk_seq, line_seq) FILTER (line_type = '-') AS minus
  FROM lines GROUP BY ALL
), per_file AS (
  SELECT diff_id, file_seq, list(DISTINCT change_type) AS types, count(*) AS n_elements,
    count(*) FILTER (starts_with(name, '_')) AS n_private, count(*) FILTER (verb = 'modified') AS n_modified
  FROM elements GROUP BY ALL
), facts AS (
  SELECT t.*, lines_added + lines_removed AS changed, coalesce(plus, '') AS plus, coalesce(minus, '') AS minus,
    coalesce(types, []) AS types, coalesce(n_elements, 0) AS n_elements, coalesce(n_private, 0) AS n_private, coalesce(n_modified, 0) AS n_modified
  FROM tagged t LEFT JOIN sides USING (diff_id, file_seq) LEFT JOIN per_file USING (diff_id, file_seq) WHERE filename <> ''
), analysis AS MATERIALIZED (
  SELECT diff_id, file_seq, filename, change_type, old_filename, language, lines_added, lines_removed,
    CASE WHEN {failed} THEN 'Analysis failed' ELSE coalesce(nullif(concat_ws('; ', {purposes}), ''), 'Code modification') END AS purpose_inference,
    CASE WHEN {failed} THEN 'Unable to assess impact' ELSE concat_ws('; ', {impacts}) END AS impact_assessment,
    (CASE WHEN {failed} THEN 0 ELSE {score} END)::BIGINT AS complexity_score,
    CASE WHEN {failed} THEN 'failed' ELSE 'ok' END AS status, changed
  FROM facts
)"""


SUMMARY = f"""
grouped AS (
  SELECT diff_id, file_seq, element_type, verb, min(element_seq) AS first_in, count(*) AS n, min_by(name, element_seq) AS one
  FROM elements GROUP BY ALL
), phrased AS (
  SELECT diff_id, file_seq, element_type, min(first_in) AS first_in,
    string_agg(CASE WHEN n = 1 THEN verb || ' ' || element_type || ' ' || one ELSE verb || ' ' || n || ' ' || element_type || 's' END,
      ', ' ORDER BY list_position(['added', 'removed', 'modified'], verb)) AS phrase
  FROM grouped GROUP BY ALL
), described AS (
  SELECT diff_id, file_seq, string_agg(phrase, '; ' ORDER BY first_in) AS structure FROM phrased GROUP BY ALL
), element_notes AS (
  SELECT diff_id, file_seq, list(upper(verb[1]) || verb[2:] || ' ' || element_type || ' ''' || name || '''' ORDER BY element_seq) AS notes
  FROM elements GROUP BY ALL
), file_summaries AS MATERIALIZED (
  SELECT a.diff_id, a.file_seq, a.filename,
    concat_ws(' - ',
      CASE change_type WHEN 'added' THEN 'Added new file ''' || filename || '''' WHEN 'deleted' THEN 'Deleted file ''' || filename || ''''
        WHEN 'renamed' THEN 'Renamed ''' || coalesce(old_filename, 'None') || ''' to ''' || filename || '''' ELSE 'Modified ''' || filename || '''' END,
      CASE WHEN lines_added + lines_removed > 0 THEN '(' || concat_ws(', ',
        CASE WHEN lines_added > 0 THEN '+' || lines_added || ' lines' END, CASE WHEN lines_removed > 0 THEN '-' || lines_removed || ' lines' END) || ')' END,
      structure, CASE WHEN purpose_inference <> 'Code modification' THEN 'Purpose: ' || purpose_inference END) AS summary,
    list_concat(coalesce(notes, []), list_filter([
      CASE WHEN complexity_score >= 7 THEN 'High complexity change (score: ' || complexity_score || '/10)'
           WHEN complexity_score >= 4 THEN 'Medium complexity change (score: ' || complexity_score || '/10)' END,
      CASE WHEN contains(lower(impact_assessment), 'high impact') THEN 'High impact change - review carefully' END], lambda x: x IS NOT NULL)) AS key_changes
  FROM analysis a LEFT JOIN described USING (diff_id, file_seq) LEFT JOIN element_notes USING (diff_id, file_seq)
), stats AS MATERIALIZED (
  SELECT d.diff_id, count(a.file_seq) AS total_files, count(*) FILTER (change_type = 'added') AS files_added,
    count(*) FILTER (change_type = 'modified') AS files_modified, count(*) FILTER (change_type = 'deleted') AS files_deleted,
    coalesce(sum(lines_added), 0)::BIGINT AS total_lines_added, coalesce(sum(lines_removed), 0)::BIGINT AS total_lines_removed,
    count(*) FILTER (complexity_score >= 7) AS n_high,
    count(*) FILTER (contains(lower(filename), 'test') OR contains(lower(filename), 'spec')) AS n_test,
    coalesce(bool_or(contains(lower(purpose_inference), 'documentation')), false) AS any_doc,
    coalesce(bool_or(contains(lower(purpose_inference), 'feature addition')), false) AS any_feature,
    coalesce(bool_or(contains(lower(impact_assessment), 'public api')), false) AS any_api
  FROM diffs d LEFT JOIN analysis a USING (diff_id) GROUP BY ALL
), purpose_rows AS (
  SELECT diff_id, file_seq, unnest(string_split(purpose_inference, '; ')) AS purpose,
    generate_subscripts(string_split(purpose_inference, '; '), 1) AS pos FROM analysis
), ranked AS MATERIALIZED (
  SELECT diff_id, purpose, n_files, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY n_files DESC, first_seen)::BIGINT AS rank FROM (
      SELECT diff_id, purpose, count(*) AS n_files, min(file_seq * 1000 + pos) AS first_seen FROM purpose_rows GROUP BY ALL)) WHERE rank <= 3
), tops AS (
  SELECT diff_id, string_agg(purpose, ', ' ORDER BY rank) AS focus FROM ranked GROUP BY ALL
), notes AS (
  SELECT diff_id, 1 AS rule, file_seq, 'High complexity change in ' || filename AS note FROM analysis WHERE complexity_score >= 7
  UNION ALL SELECT diff_id, 2, 0, 'Multiple new files added (' || files_added || ' files)' FROM stats WHERE files_added > 3
  UNION ALL SELECT a.diff_id, 2, file_seq, 'New file: ' || filename FROM analysis a JOIN stats s USING (diff_id) WHERE change_type = 'added' AND files_added <= 3
  UNION ALL SELECT diff_id, 3, file_seq, 'Deleted file: ' || filename FROM analysis WHERE change_type = 'deleted'
  UNION ALL SELECT diff_id, 4, file_seq, 'Large change in ' || filename || ' (' || changed || ' lines)' FROM analysis WHERE changed > 100
  UNION ALL SELECT diff_id, 5, file_seq, 'Multiple class changes in ' || filename FROM analysis
    JOIN (SELECT diff_id, file_seq FROM elements WHERE contains(change_type, 'class') GROUP BY ALL HAVING count(*) > 2) USING (diff_id, file_seq)
), noted AS (
  SELECT diff_id, list(note ORDER BY rule, file_seq)[1:10] AS key_changes FROM notes GROUP BY ALL
), imports AS (
  SELECT DISTINCT diff_id FROM elements WHERE contains(change_type, 'import')
), listed_files AS (
  SELECT diff_id, list(struct_pack(filename := filename, summary := summary, key_changes := key_changes) ORDER BY file_seq) AS file_summaries
  FROM file_summaries GROUP BY ALL
), parsed AS (
  SELECT diff_id, count(*) AS parsed_files FROM files GROUP BY ALL
), summaries AS MATERIALIZED (
  SELECT s.diff_id, CASE WHEN total_files = 0 THEN 'No changes detected' ELSE concat_ws('. ',
      CASE WHEN total_files = 1 THEN '1 file changed' ELSE total_files || ' files changed' END,
      CASE WHEN files_added > 0 THEN files_added || ' added' END, CASE WHEN files_modified > 0 THEN files_modified || ' modified' END,
      CASE WHEN files_deleted > 0 THEN files_deleted || ' deleted' END,
      CASE WHEN total_lines_added + total_lines_removed > 0 THEN '(' || concat_ws(', ',
        CASE WHEN total_lines_added > 0 THEN '+' || total_lines_added END, CASE WHEN total_lines_removed > 0 THEN '-' || total_lines_removed END) || ' lines)' END,
      'Primary focus: ' || focus) || '.' END AS overview,
    total_files, files_added, files_modified, files_deleted, total_lines_added, total_lines_removed,
    coalesce(file_summaries, []) AS file_summaries, coalesce(key_changes, []) AS key_changes,
    CASE WHEN total_files = 0 THEN [] ELSE list_filter([
      CASE WHEN n_high > 0 THEN 'Review ' || n_high || ' high-complexity changes carefully' END,
      CASE WHEN total_files - n_test > 2 * n_test THEN {q(fixed.ADVICE_TESTS)} END,
      CASE WHEN any_feature AND NOT any_doc THEN {q(fixed.ADVICE_DOCS)} END,
      CASE WHEN any_api THEN {q(fixed.ADVICE_API)} END,
      CASE WHEN total_lines_added + total_lines_removed > 500 THEN {q(fixed.ADVICE_SIZE)} END,
      CASE WHEN i.diff_id IS NOT NULL THEN {q(fixed.ADVICE_IMPORTS)} END], lambda x: x IS NOT NULL)[1:8] END AS recommendations,
    coalesce(parsed_files, 0) AS parsed_files
  FROM stats s LEFT JOIN tops USING (diff_id) LEFT JOIN noted USING (diff_id) LEFT JOIN listed_files USING (diff_id)
    LEFT JOIN parsed USING (diff_id) LEFT JOIN imports i ON i.diff_id = s.diff_id
)"""


def through(
    step: str,
    compat: bool = False,
    languages: dict[str, str] | None = None,
    patterns: dict[str, dict[str, str]] | None = None,
    blanked: str = "",
) -> str:
    """The WITH clause up to and including a step; ``blanked`` replaces columns of the analysis."""
    analysis = _analysis(compat)
    if blanked:
        analysis = analysis.replace("analysis AS MATERIALIZED", "whole_analysis AS MATERIALIZED")
        analysis += f", analysis AS MATERIALIZED (SELECT * REPLACE ({blanked}) FROM whole_analysis)"
    steps = {
        "diffs": _corpus(),
        "parse": PARSE,
        "languages": _languages(languages or {}),
        "elements": _found(patterns or {}) + "," + _elements(compat),
        "analysis": analysis,
        "summary": SUMMARY,
    }
    names = list(steps)
    return "WITH " + ",".join(steps[name] for name in names[: names.index(step) + 1]) + "\n"


# --- rendering --------------------------------------------------------------


def _lines(*items: str) -> str:
    return f"concat_ws({NL}, {', '.join(items)})"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _bullets(items: str, mark: str = "- ") -> str:
    return f"array_to_string(list_transform({items}, lambda x: '{mark}' || x), {NL})"


def _numbered(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: '  ' || i || '. ' || x), {NL})"


def markdown() -> str:
    per_file = _lines(
        "'### ' || f.filename", "f.summary",
        _when("len(f.key_changes) > 0", _lines("''", "'**Key changes:**'", _bullets("f.key_changes"))), "''",
    )
    files = f"array_to_string(list_transform(file_summaries, lambda f: {per_file}), {NL})"
    return _lines(
        "'# Code Change Summary'", "''", "'## Overview'", "overview", "''", "'## Statistics'",
        "'- **Total files changed:** ' || total_files",
        _when("files_added > 0", "'- **Files added:** ' || files_added"),
        _when("files_modified > 0", "'- **Files modified:** ' || files_modified"),
        _when("files_deleted > 0", "'- **Files deleted:** ' || files_deleted"),
        "'- **Lines added:** +' || total_lines_added", "'- **Lines removed:** -' || total_lines_removed", "''",
        _when("len(key_changes) > 0", _lines("'## Key Changes'", _bullets("key_changes"), "''")),
        _when("len(file_summaries) > 0", _lines("'## File Details'", files)),
        _when("len(recommendations) > 0", _lines("'## Recommendations'", _bullets("recommendations"), "''")),
    )


def plain() -> str:
    per_file = _lines(
        "'File: ' || f.filename", "'Summary: ' || f.summary",
        _when("len(f.key_changes) > 0", _lines("'Key changes:'", _bullets("f.key_changes", "  - "))), "''",
    )
    files = f"array_to_string(list_transform(file_summaries, lambda f: {per_file}), {NL})"
    return _lines(
        "'CODE CHANGE SUMMARY'", "repeat('=', 50)", "''", "'OVERVIEW:'", "overview", "''", "'STATISTICS:'",
        "'  Total files changed: ' || total_files",
        _when("files_added > 0", "'  Files added: ' || files_added"),
        _when("files_modified > 0", "'  Files modified: ' || files_modified"),
        _when("files_deleted > 0", "'  Files deleted: ' || files_deleted"),
        "'  Lines added: +' || total_lines_added", "'  Lines removed: -' || total_lines_removed", "''",
        _when("len(key_changes) > 0", _lines("'KEY CHANGES:'", _numbered("key_changes"), "''")),
        _when("len(file_summaries) > 0", _lines("'FILE DETAILS:'", "repeat('-', 30)", files)),
        _when("len(recommendations) > 0", _lines("'RECOMMENDATIONS:'", _numbered("recommendations"), "''")),
    )


def file_block() -> str:
    per_file = _lines("'- ' || f.filename || ': ' || f.summary", _when("len(f.key_changes) > 0", _bullets("f.key_changes", "  - ")))
    return f"CASE WHEN len(file_summaries) = 0 THEN 'No file changes' ELSE array_to_string(list_transform(file_summaries, lambda f: {per_file}), {NL}) END"
