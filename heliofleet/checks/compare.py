"""Run a registered query and its oracle over the same parquet files and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from . import load_all


def _normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    def cell(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        if hasattr(x, "isoformat"):
            return str(x)[:10]
        if hasattr(x, "item"):
            x = x.item()
        return repr(float(x)) if isinstance(x, float) else x
    return sorted((tuple(cell(x) for x in row) for row in df.itertuples(index=False)), key=repr)


def compare(spark: SparkSession, d: str, name: str) -> tuple[bool, str]:
    queries, oracles = load_all()
    t0 = time.time()
    got = queries[name](spark, d).toPandas()
    spent = time.time() - t0
    if name not in oracles:
        return len(got) > 0, f"rows={len(got)} {spent:.1f}s (no oracle)"
    con = duckdb.connect()
    for f in glob.glob(os.path.join(d, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(oracles[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = _normal(got), _normal(want)
    if a == b:
        kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype]
        return True, f"rows={len(a)} {spent:.1f}s {kinds or ''}"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"rows {len(a)} vs {len(b)} {sorted(got.columns)} {diff}"


def main() -> None:
    from ..session import build_session

    d = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    names = [n for n in load_all()[0] if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, d, name)
        except Exception as e:  # noqa: BLE001 - a report over all queries
            ok, note = False, str(e)[:900]
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)}")


if __name__ == "__main__":
    main()
