"""Compare registered queries with their checking SQL: python tests/compare.py SF [name ...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def checking_engine(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def compare(spark, connection, name, query, sql, sf_dir):
    started = time.time()
    ours = query(spark, sf_dir).toPandas()
    middle = time.time()
    theirs = connection.execute(sql).df()
    took = f"spark {middle - started:.1f}s sql {time.time() - middle:.1f}s"
    (our_columns, our_rows), (their_columns, their_rows) = rows_of(ours), rows_of(theirs)
    if our_columns != their_columns:
        return False, f"columns {our_columns} {their_columns}"
    if our_rows != their_rows:
        only_ours = sorted(set(our_rows) - set(their_rows))[:2]
        only_theirs = sorted(set(their_rows) - set(our_rows))[:2]
        return False, f"{len(our_rows)} vs {len(their_rows)} rows\n  ours   {only_ours}\n  theirs {only_theirs}"
    return True, f"{len(our_rows)} rows {took}"


if __name__ == "__main__":
    from workload import catalog

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks, connection = catalog.oracle_sql(), checking_engine(sf_dir)
    for name, query in catalog.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            same, note = compare(spark, connection, name, query, checks[name], sf_dir)
        except Exception as error:
            same, note = False, str(error)[:700]
        print("ok  " if same else "FAIL", name, note[:1500], flush=True)
