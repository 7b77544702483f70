"""Patch files as tables, and rendered text as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.operators.parse import DIFF_ID, FILE_MARK

PATH = ("path",)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where they are no valid UTF-8; all line ends become LF."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_patch_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """One row per patch file: ``path``, ``diff_text``.

    For files that fit in one row.  Spark lists no files of zero length, so an
    empty patch file has no row.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path if isinstance(path, str) else list(path))
    return files.select("path", decoded(F.col("content")).alias("diff_text"))


#: Keys that ``files_from_sections`` carries for rows of ``read_patch_sections``.
SECTION_KEYS = ("path", "block", "opens")


def read_patch_sections(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """One row per file section of each patch file: ``path``, ``block``, ``opens``, ``file_seq``, ``section``.

    For patch files of any size, in one scan without a join or a shuffle: a file
    is split over many tasks at its ``diff --git`` lines, so neither a row nor a
    task holds it whole.  ``file_seq`` is an order key, not a number: sections
    of a file follow each other by (``block``, ``file_seq``), where ``block`` is
    the start of the input block that read them.  ``opens`` tells a record that
    starts with ``diff --git``; the first record of a file that doesn't is text
    before the first file.  Feed the rows to ``files_from_sections`` with
    ``keys=SECTION_KEYS`` and give the small result to ``number_files`` for the
    numbers 1, 2, ... of each file.

    Each section is decoded on its own: UTF-8 where it is valid, else Latin-1
    (``read_patch_files`` decides for a whole file).  Line ends become LF; a
    lone CR at the very end of a file is dropped.  File starts after a lone CR
    are not seen here; ``read_patch_files`` sees them.
    """
    reader = spark.read.option("lineSep", "\n" + FILE_MARK)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(path if isinstance(path, str) else list(path))
    value = F.col("value")
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))
    # The separator took the LF of a CRLF before the next file; its CR goes too.
    text = F.regexp_replace(F.regexp_replace(text, r"\r\z", ""), r"\r\n?", "\n")
    opens = value.startswith(FILE_MARK)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        opens.alias("opens"),
        F.monotonically_increasing_id().alias("file_seq"),
        F.when(opens, text).otherwise(F.concat(F.lit(FILE_MARK), text)).alias("section"),
    )


def number_files(files: DataFrame, keys: Sequence[str] = PATH) -> DataFrame:
    """Rows of ``files_from_sections`` over ``read_patch_sections`` with ``file_seq`` 1, 2, ... per file.

    Text before a file's first section goes.  The numbers come from one row per
    input block (its record count, first order key and whether it opens with a
    file), summed over the blocks before it: a window over a file's blocks,
    never over its sections.  That small table is computed by a second pass over
    the files that reads no text into the rows it joins; the rows of ``files``
    are not shuffled for it beyond that join, which AQE may turn into a broadcast.
    The columns ``block`` and ``opens`` go.
    """
    owner = [*keys]
    blocks = files.groupBy(*owner, "block").agg(
        F.count("*").alias("n"),
        F.min("file_seq").alias("first_seq"),
        F.min_by("opens", "file_seq").alias("first_opens"),
    )
    before = Window.partitionBy(*owner).orderBy("block")
    layout = blocks.select(
        *owner,
        "block",
        "first_seq",
        (F.sum("n").over(before) - F.col("n")).alias("skipped"),
        F.first("first_opens").over(before).alias("starts_with_file"),
    )
    placed = files.join(layout, [*owner, "block"])
    place = F.col("skipped") + F.col("file_seq") - F.col("first_seq")
    number = place + F.when(F.col("starts_with_file"), 1).otherwise(0)
    rest = [c for c in files.columns if c not in (*owner, "block", "opens", "file_seq")]
    return placed.select(*owner, number.alias("file_seq"), *rest).where(F.col("file_seq") > 0)


def write_rendered(rendered: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Rendered texts as UTF-8 text files, replacing what was there.

    ``by`` puts each value of those columns, which should be few, into a folder
    of its own.  Which text belongs to which change set is not kept; use
    ``write_reports`` for that.
    """
    rendered.select(*by, "rendered").write.mode("overwrite").partitionBy(*by).text(path)


def write_reports(
    rendered: DataFrame, path: str, keys: Sequence[str] = DIFF_ID, format_name: str = "parquet"
) -> None:
    """One row (keys, rendered) per change set, as Parquet or JSON, replacing what was there."""
    rendered.select(*keys, "rendered").write.mode("overwrite").format(format_name).save(path)


def write_parts(parts: DataFrame, path: str, keys: Sequence[str] = DIFF_ID) -> None:
    """The pieces of ``render_parts`` as text files, in order, replacing what was there.

    Range partitions split even one change set over many tasks.
    """
    order = [*keys, "part"]
    placed = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("text").write.mode("overwrite").text(path)
