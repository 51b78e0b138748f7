"""Run a registered query and its SQL over the same files and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()
KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, list):
        return tuple(v)
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and the SQL's result; empty means equal."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    order = sorted(names)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=_key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in want), key=_key)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cols = [c for c, a, b in zip(order, g, w) if a != b]
        problems.append(
            f"{len(bad)} of {len(want)} rows differ, first in {cols}: "
            f"{[x for x, y in zip(g, w) if x != y]} != {[y for x, y in zip(g, w) if x != y]}")
    return problems


def main(argv: list[str]) -> int:
    from failscope import plans
    from tests.session import make_session

    folder, names = argv[0], argv[1:]
    registry = plans.load()
    spark, con = make_session(), connect(folder)
    failed = 0
    for name in names or registry.QUERIES:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, folder)
            if name in registry.ORACLES:
                problems = compare(df, con, registry.ORACLES[name])
                state = "ok" if not problems else "DIFFERENT"
            else:
                problems, state = [], f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            problems, state = [str(error)[:1500]], "ERROR"
        failed += bool(problems)
        print(f"{name:28s} {state:10s} {time.time() - start:6.1f}s", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
