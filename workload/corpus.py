"""Change sets made from the ``documents`` table.

The given tables hold no diffs, so the workload turns each document into one
file of a diff.  Of each hundred documents (by ``doc_id``) the first forty make
one change set, the next forty-eight make twelve, the others one each.  The
whole text of every document is used.  The rules are plain integer and string
arithmetic, so the same table can be written in Spark SQL and, independently,
for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchloom import fixed_values as fixed

EXTENSIONS = ["py", "js", "ts", "java", "go", "rs", "md", "json", "cpp"]
# Every tenth document takes its extension or its whole name from these in turn.
MORE_EXTENSIONS = [e[1:] for e in fixed.LANGUAGE_BY_EXTENSION if e[1:] not in EXTENSIONS] + ["txt", "rst", "xyz"]
WHOLE_NAMES = ["Makefile", "Dockerfile", "package.json", "tsconfig.json", ".gitignore", ".env"]
# Some documents repeat their code lines, with a number behind each name, so that files get long.
REPEATS = [30, 60, 150]

# Code lines by extension; <d> stands for the document's number.
CODE_LINES = {
    "py": ["def feat_<d>(a):", "class Model<d>(Base):", "import os, sys", "    _cache = <d>", "@cached_<d>"],
    "js": ["class Widget<d> {", "const v<d> = 1;", "const run<d> = (x) => x;", "function _go<d>() {"],
    "ts": ["export interface Opt<d> {", "export type T<d> = string;", "export class C<d> {", "let n = 1;"],
    "java": ["public class Svc<d> {", "import java.util.List;", "  private int _n<d>;", "  public void run<d>() {"],
    "go": ["func Run<d>() {", "type S<d> struct {", "\tcount<d> := 1", "type R<d> interface {"],
    "rs": ["pub fn go_<d>() {", "use std::fmt;", "impl<T> Show for S<d> {", "pub enum E<d> {", "pub trait T<d> {"],
    "other": ["plain line", "# TODO note", "value = <d>", "\t"],
}
# Extra line on every third js, ts and go document: an import without a name.
NAMELESS_IMPORTS = {
    "js": "import { a<d> } from 'lib';",
    "ts": "import lib from \"lib\";",
    "go": "import \"fmt\"",
}


def _code_case() -> str:
    def lines(ext: str) -> str:
        listed = f"array({', '.join(map(_sql_text, CODE_LINES[ext]))})"
        if ext in NAMELESS_IMPORTS:
            extra = _sql_text(NAMELESS_IMPORTS[ext])
            listed = f"CASE WHEN d % 3 = 1 THEN concat({listed}, array({extra})) ELSE {listed} END"
        return listed

    cases = " ".join(f"WHEN '{e}' THEN {lines(e)}" for e in CODE_LINES if e != "other")
    return f"CASE ext {cases} ELSE {lines('other')} END"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t") + "'"


def _in_turn(values: list[str], number: str) -> str:
    return f"array({', '.join(map(_sql_text, values))})[cast({number} % {len(values)} AS int)]"


def _sql() -> str:
    repeats = f"array({', '.join(map(str, REPEATS))})[cast(doc_id div 23 % {len(REPEATS)} AS int)]"
    return f"""
WITH docs AS (
  SELECT doc_id AS d, source, split(text, '\\n') AS lines,
         CASE WHEN doc_id % 100 < 40 THEN doc_id - doc_id % 100
              WHEN doc_id % 100 < 88 THEN doc_id - doc_id % 4 ELSE doc_id END AS diff_id,
         CASE WHEN doc_id % 10 = 9 THEN {_in_turn(MORE_EXTENSIONS, "doc_id div 10")}
              ELSE {_in_turn(EXTENSIONS, "doc_id % 10")} END AS ext,
         CASE WHEN doc_id % 23 = 5 THEN {repeats} ELSE 1 END AS n_code,
         CASE doc_id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS kind
  FROM DOCUMENTS
), named AS (
  SELECT *, CASE WHEN d % 20 = 6 THEN 'README.md'
                 WHEN d % 40 = 18 THEN {_in_turn(WHOLE_NAMES, "d div 40")}
                 ELSE concat('src/', source, '/', CASE WHEN d % 9 = 0 THEN 'test_f' ELSE 'f' END, d, '.', ext) END AS path,
         transform(sequence(0, n_code - 1), i -> transform({_code_case()},
           c -> replace(c, '<d>', CASE WHEN i = 0 THEN string(d) ELSE concat(d, '_', i) END))) AS copies
  FROM docs
), coded AS (
  SELECT *, flatten(copies) AS code FROM named
), bodies AS (
  SELECT *, CASE WHEN kind = 'renamed' THEN concat('old/f', d, '.', ext) ELSE path END AS old_path,
    CASE
      WHEN kind = 'deleted' OR (kind <> 'added' AND d % 5 = 2) THEN transform(code, c -> concat('-', c))
      WHEN kind <> 'added' AND d % 3 = 0 THEN concat(transform(code, c -> concat('-', c)), transform(code, c -> concat('+', c)))
      WHEN kind <> 'added' AND d % 3 = 1 THEN concat(transform(slice(code, 1, 2), c -> concat('-', c)), transform(code, c -> concat('+', c)))
      ELSE transform(code, c -> concat('+', c)) END AS code_body,
    transform(lines, (x, i) -> concat(
      CASE WHEN i > 0 AND i % 12 = 0 THEN
        CASE WHEN d % 11 = 5 AND i % 24 = 12 THEN concat('@@ malformed ', i, '\\n')
             ELSE concat('@@ -', 100 + i, ' +', 200 + i, ',7 @@ def ctx_', i, ' \\n') END ELSE '' END,
      CASE WHEN kind = 'added' THEN '+' WHEN kind = 'deleted' THEN '-'
           ELSE array('+', '-', ' ', '+', '', ' ')[cast((i + d) % 6 AS int)] END, x)) AS text_body
  FROM coded
), sections AS (
  SELECT d, diff_id, concat(
    CASE WHEN d % 13 = 3 THEN concat('diff --git ', path)
         WHEN d % 29 = 7 THEN 'diff --git a/ b/'
         ELSE concat('diff --git a/', old_path, ' b/', path) END, '\\n',
    CASE kind WHEN 'added' THEN 'new file mode 100644\\n' WHEN 'deleted' THEN 'deleted file mode 100644\\n'
              WHEN 'renamed' THEN concat('rename from ', old_path, '\\nrename to ', path, '\\n') ELSE '' END,
    'index 1111111..2222222 100644\\n--- a/', path, '\\n+++ b/', path, '\\n',
    '@@ -1,', size(lines), ' +1,', size(lines), ' @@ ctx\\n',
    array_join(code_body, '\\n'), '\\n', array_join(text_body, '\\n'),
    CASE WHEN d % 17 = 9 THEN '\\ndeleted file mode 100644\\nrename to elsewhere' ELSE '' END,
    CASE WHEN d % 8 = 2 THEN '\\n\\\\ No newline at end of file' ELSE '' END) AS section
  FROM bodies
), joined AS (
  SELECT diff_id,
         array_join(transform(array_sort(collect_list(struct(d, section))), s -> s.section), '\\n') AS body
  FROM sections GROUP BY diff_id
)
SELECT diff_id, concat(
    CASE WHEN diff_id % 6 = 4 THEN 'Subject: change\\n@@ -1 +1 @@ stray\\n+stray\\n' ELSE '' END,
    body, CASE WHEN diff_id % 5 = 0 THEN '\\n' ELSE '' END) AS diff_text
FROM joined
UNION ALL
SELECT 1000000000 + doc_id AS diff_id,
       CASE doc_id % 150 WHEN 0 THEN '' WHEN 50 THEN ' \\n\\t\\n' ELSE concat('--- a/f', doc_id, '\\n+++ b/f\\n@@ -1 +1 @@\\n+x') END AS diff_text
FROM DOCUMENTS WHERE doc_id % 50 = 0
"""


SQL = _sql()


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change sets as ``(diff_id BIGINT, diff_text STRING)``."""
    return spark.sql(SQL.replace("DOCUMENTS", f"parquet.`{sf_dir}/documents.parquet`"))
