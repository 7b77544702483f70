"""Removal of lines that many sites share.

Each distinct line gets a HyperLogLog sketch of the sites it stands on; the
sketches merge by aggregation.  Lines whose estimate is within ``BAND`` of the
limit get an exact distinct count; those above the band are boilerplate, those
below are not.  A boilerplate line stays where it first stands (least document
id, then first position) and goes everywhere else.

Lines are compared without blanks at their ends; blank lines stay.  A null site
is a site of its own.  Null texts stay null, empty texts empty.  Identical rows
are treated alike.  A line whose documents all have null ids counts its first
place among those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.shared import private, saved

MIN_SITES = 10
#: Fixed by the sketch's size: 2**LG_K registers have a relative error of about 1.04 / sqrt(2**LG_K).
LG_K = 10
BAND = 5 * 1.04 / 2 ** (LG_K / 2)


def _two_hashes(*columns: Column) -> Column:
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _lines(text: str) -> Column:
    return F.split(text, "\n", -1)


def _rows(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that isn't blank: line, site, doc_id, doc, pos."""
    own = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"),
        _two_hashes(F.col("doc_id"), F.col("text")).alias("doc"),
        F.posexplode(_lines("text")).alias("pos", "line_text"),
    )
    line = F.trim(F.col("line_text"))
    return own.where(line != "").select("doc_id", "site", "doc", "pos", _two_hashes(line).alias("line"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` sites: line, first (doc_id, pos)."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")
    lines = rows.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(place).alias("first"))
    lines = lines.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = saved(lines.where(F.col("sites") >= min_sites * (1 - BAND)))
    sure = F.col("sites") > min_sites * (1 + BAND)
    near = likely.where(~sure).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n"))
    counted = likely.where(~sure).join(exact.where(F.col("n") >= min_sites), "line", "left_semi")
    return likely.where(sure).union(counted).select("line", "first")


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, counts: bool = False
) -> DataFrame:
    """``docs`` without repeated boilerplate lines in ``text``; all columns stay.

    With ``counts`` the columns ``n_lines`` and ``n_removed`` follow (in place of
    columns of those names).  Other columns keep their names, whatever they are.
    """
    rows = _rows(docs, site)
    common = saved(boilerplate(rows, min_sites))
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")))
    places = rows.join(common, "line").where(again).groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    own_doc, own_gone, own_lines, own_text = (private(docs, f"line_dedup_{x}") for x in ("doc", "gone", "lines", "text"))
    gone = saved(places.select(F.col("doc").alias(own_doc), F.col("gone").alias(own_gone)))
    key = _two_hashes(F.col("doc_id"), F.col("text"))
    joined = docs.join(gone, key == F.col(own_doc), "left")
    # what stands between two removed lines is one slice
    cuts = f"concat(array(-1), {own_gone}, array(size(split(text, '\\n', -1))))"
    kept = f"""array_join(flatten(transform(slice({cuts}, 2, size({own_gone}) + 1), (at, i) ->
        slice({own_lines}, {cuts}[i] + 2, at - {cuts}[i] - 1))), '\\n')"""
    gone_rows = joined.withColumn(own_lines, F.when(F.col(own_gone).isNotNull(), _lines("text")))
    text = F.when(F.col(own_gone).isNull(), F.col("text")).otherwise(F.expr(kept))
    out = gone_rows.withColumn(own_text, text)
    added = ["n_lines", "n_removed"] if counts else []
    columns = [F.col(own_text).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in added]
    if counts:
        columns += [
            F.coalesce(F.size(_lines("text")), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size(own_gone), F.lit(0)).cast("bigint").alias("n_removed"),
        ]
    return out.select(*columns)
