"""Run registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
            return repr(float(v))
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


def differences(spark_df, con, sql: str) -> str | None:
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    for c in ours.columns:
        if ours[c].dtype.kind != theirs[c].dtype.kind and "O" not in (ours[c].dtype.kind + theirs[c].dtype.kind):
            return f"type of {c}: {ours[c].dtype} / {theirs[c].dtype}"
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    from runlens.registry import ORACLES, QUERIES
    from runlens.session import session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                          "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, fn in QUERIES.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                result = differences(fn(spark, sf_dir), con, ORACLES[name]) or "ok"
            else:
                result = f"rows {len(fn(spark, sf_dir).toPandas())}"
        except Exception as error:  # report and go on with the next query
            result = "ERROR " + str(error).split("JVM stacktrace")[0][:1500]
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
