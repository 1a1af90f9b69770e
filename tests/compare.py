"""Compare registered queries with their DuckDB statements: ``python tests/compare.py sf0.01 [name ...]``."""

import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_duckdb(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def differences(spark, connection, name, folder):
    """Empty text when columns and rows agree, else what differs."""
    import __spark_entry__ as contract

    frame = contract.queries()[name](spark, folder)
    order = sorted(frame.columns)
    mine = Counter(tuple(r) for r in frame.select(*[f"`{c}`" for c in order]).collect())
    relation = connection.sql(contract.oracle_sql()[name])
    if sorted(relation.columns) != order:
        return f"columns {order} and {sorted(relation.columns)}"
    wanted = relation.select(", ".join(f'"{c}"' for c in order))
    theirs = Counter(wanted.fetchall())
    types = {c: str(t) for c, t in zip(wanted.columns, wanted.types)}
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for column, kind in frame.dtypes:
        if kinds.get(kind) != types[column]:
            return f"type of {column}: {kind} and {types[column]}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return f"{sum(extra.values())} extra, {sum(missing.values())} missing of {sum(theirs.values())}: {list(extra)[:3]} / {list(missing)[:3]}"
    return ""


if __name__ == "__main__":
    from arborlens.session import build_session

    import __spark_entry__ as contract

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sys.argv[1]}"
    connection = open_duckdb(folder)
    for name in sys.argv[2:] or contract.queries():
        started = time.time()
        try:
            found = differences(spark, connection, name, folder)
        except Exception as problem:
            found = f"{type(problem).__name__} {str(problem)[:600]}"
        print(f"\n>> {name} {time.time() - started:.1f}s {found or 'ok'}"[:1200], flush=True)
