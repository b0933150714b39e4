"""Run registered queries against their comparison SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows), sorted(columns)


def difference(spark, con, run, sql, sf_dir):
    """None if both sides agree, else a short description."""
    got = run(spark, sf_dir)
    mine, names = normal([tuple(r) for r in got.collect()], got.columns)
    cursor = con.execute(sql)
    theirs, expected = normal(cursor.fetchall(), [d[0] for d in cursor.description])
    if names != expected:
        return f"columns {names} != {expected}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, columns {names}, e.g. {wrong[0][0]} != {wrong[0][1]}"
    return "empty on both sides" if not mine else None


def main():
    import __spark_entry__ as contract
    from tests.conftest import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session()
    if "FLIGHTSEAL_WINDOW_ROWS" in os.environ:  # cut flights even where they are short
        spark.conf.set("spark.flightseal.windowRows", os.environ["FLIGHTSEAL_WINDOW_ROWS"])
    con = connect(sf_dir)
    oracles = contract.oracle_sql()
    failures = 0
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, run, oracles[name], sf_dir)
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                frame = run(spark, sf_dir)
                rows = frame.collect()
                note = f"rows={len(rows)} {rows[0].asDict() if rows else ''}"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failures += note.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
