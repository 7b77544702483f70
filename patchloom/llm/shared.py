"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the runs of characters other than these blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z become a-z, every other byte stays.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the place that the driver and all executors share.

    That place is the session's ``spark.checkpoint.dir``.  Where it is unset, a
    local session gets a temporary folder; a cluster has to name one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{place.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept by a checkpoint in the shared folder, which Spark clears when it is done with it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: A table is broadcast only up to this many rows, counted first; above, the planner joins by shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows (``BROADCAST_ROWS``), else as it is."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def private(df: DataFrame, name: str) -> str:
    """``name`` made longer than every column of ``df``, so an operator's own column never meets a caller's."""
    return name + "_" * (1 + max((len(c) for c in df.columns), default=0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text (null: of the empty text) modulo ``divisor``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_object(spark: SparkSession, value: Any) -> Broadcast:
    """An object of this package's classes for all tasks, with its classes; ``received`` opens it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)
