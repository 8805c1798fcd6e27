"""Run a registered query and its SQL side by side and compare rows and types."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def arrow(con, sql: str) -> pa.Table:
    got = con.execute(sql).to_arrow_table()
    return got if isinstance(got, pa.Table) else got.read_all()


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def rows(tab: pa.Table) -> list:
    cols = sorted(tab.column_names)
    return sorted(map(repr, zip(*[tab.column(c).to_pylist() for c in cols]))) if cols else []


def compare(got: pa.Table, want: pa.Table) -> str | None:
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    for c in got.column_names:
        a, b = _kind(got.schema.field(c).type), _kind(want.schema.field(c).type)
        if a != b:
            return f"type of {c}: {a} != {b}"
    a, b = rows(got), rows(want)
    if a == b:
        return None
    from collections import Counter
    ca, cb = Counter(a), Counter(b)
    return (f"{len(a)} vs {len(b)} rows; cols {sorted(got.column_names)}\n  only spark: "
            f"{[x[:300] for x in list(ca - cb)[:3]]}\n  only sql:   {[x[:300] for x in list(cb - ca)[:3]]}")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from importlib import import_module

    from pyspark.sql import SparkSession
    sf, mods, only = sys.argv[1], sys.argv[2].split(","), sys.argv[3:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf), 0
    for m in mods:
        mod = import_module(f"bookflow.plans.{m}")
        for name, fn in mod.QUERIES.items():
            if only and name not in only:
                continue
            t0 = time.time()
            try:
                got = fn(spark, sf).toArrow()
                t1 = time.time()
                if name not in mod.SQL:
                    print(f"-- {name}: {got.num_rows} rows, no sql {t1 - t0:.1f}s", flush=True)
                    continue
                want = arrow(con, mod.SQL[name])
                msg = compare(got, want)
                print(f"{'ok' if msg is None else 'XX'} {name} {got.num_rows} spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s "
                      + (msg or ""), flush=True)
            except Exception as e:
                msg = str(e)
                print(f"!! {name}: {type(e).__name__} {msg[:700]}", flush=True)
            bad += msg is not None
    print("failures:", bad)
