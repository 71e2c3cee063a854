"""Run registered queries next to their SQL: ``python tests/parity.py [sf] [query ...]``."""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def fingerprint(table) -> tuple[list[tuple[str, str]], int, str]:
    """Column names with types, row count, and a hash of the rows that ignores their order."""
    names = sorted(table.column_names)
    table = table.select(names).combine_chunks()
    columns = [[repr(v) for v in table.column(n).to_pylist()] for n in names]
    rows = sorted("|".join(r) for r in zip(*columns))
    digest = hashlib.md5("\n".join(rows).encode()).hexdigest()
    return [(n, str(table.schema.field(n).type)) for n in names], len(rows), digest


def compare(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    ours = fingerprint(query(spark, sf_dir).toArrow())
    theirs = fingerprint(con.sql(sql).to_arrow_table())
    labels = ("columns", "row count", "values")
    return [f"{n}: {a} != {b}" for n, a, b in zip(labels, ours, theirs) if a != b]


def main() -> int:
    import __spark_entry__ as registered

    from cellkpi.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = registered.queries(), registered.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    settings = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8"}
    settings |= {"spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    spark = build_session("parity", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        begin = time.time()
        differences = compare(spark, con, sf_dir, queries[name], oracle[name])
        bad += bool(differences)
        print(f"{'DIFF' if differences else 'ok':4} {name} {time.time() - begin:.1f}s", flush=True)
        for d in differences:
            print("    ", d[:1500])
    print(f"{len(chosen) - bad} of {len(chosen)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
