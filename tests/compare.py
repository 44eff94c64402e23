"""Run registered queries next to their DuckDB statements: ``python tests/compare.py SF_DIR [name …]``."""

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float"}


def compare(con, df, sql):
    """Empty text when rows and types agree, else what differs."""
    columns = sorted(df.columns)
    got = Counter(tuple(cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(cell(row[i]) for i in order) for row in out.fetchall())
    types = {r[0]: KINDS.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad = {n: (t, types[n]) for n, t in df.dtypes if t != types[n]}
    if bad:
        return f"types {bad}"
    if got != want:
        return f"rows {sum(got.values())} / {sum(want.values())}; only ours {list((got - want).items())[:3]}; only theirs {list((want - got).items())[:3]}"
    return "" if got else "no rows"


def main():
    from evalloom import build_session
    from evalloom.queries import ORACLES, QUERIES

    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            note = compare(con, df, ORACLES[name]) if name in ORACLES else f"{df.count()} rows, no statement"
        except Exception as error:
            note = f"{type(error).__name__}: {str(error)[:900]}"
        if note:
            failed.append(name)
        print(f"{'ok ' if not note else 'BAD'} {name} {time.time() - start:.1f}s {note[:1500]}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
