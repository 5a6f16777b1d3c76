"""Compare registered queries with their oracles: python tools/check.py <sf dir> [name…]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daygrid.plans.catalog import REGISTRY, run_query  # noqa: E402
from daygrid.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(v):
    if isinstance(v, float) and (math.isnan(v)):
        return "NaN"
    if isinstance(v, list):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, folder):
    df = run_query(name, spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    entry = REGISTRY[name]
    if entry.sql is None:
        return "rows only", len(got), ""
    rel = con.execute(entry.sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), f"{sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return "COUNT", len(got), f"{len(got)} vs {len(want)}; first {got[:1]} {want[:1]}"
    kinds = dict(zip(names, [str(d[1]) for d in rel.description], strict=True))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = {c: (types[c], kinds[c]) for c in names if pairs.get(types[c], types[c]) != kinds[c]}
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    if bad:
        return "VALUES", len(got), f"{len(bad)} differ; {sorted(names)}; e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return "ok", len(got), f"types {off}" if off else ""


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failures = 0
    for name in REGISTRY:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            state, n, note = compare(spark, con, name, folder)
        except Exception as e:
            state, n, note = "ERROR", 0, "".join(traceback.format_exception_only(e))[:1500]
        failures += state not in ("ok", "rows only")
        print(f"{state:10} {name:36} rows={n:<7} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
