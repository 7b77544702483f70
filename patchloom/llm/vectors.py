"""Integer vectors of the ``embeddings`` table, shared by the searches of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds no null, NaN or infinite component (an empty one is usable)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x taken as a double; a BIGINT array."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def squared_norm(ints: Column) -> Column:
    return F.aggregate(ints, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def integer_rows(df: DataFrame, scale: int, id_col: str, vector: str, *keep: str) -> DataFrame:
    """(id, ints, norm, keep...) of the usable rows with a non-null id; ``id`` is BIGINT."""
    rows = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    ints = scaled(F.col(vector), scale)
    out = rows.select(F.col(id_col).cast("bigint").alias("id"), ints.alias("ints"), *[F.col(k) for k in keep])
    return out.withColumn("norm", F.sqrt(squared_norm(F.col("ints"))))
