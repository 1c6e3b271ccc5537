"""Run queries next to their SQL in DuckDB: python tests/check_oracle.py [name ...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from gaugewatch.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cells = [[None if v is None or v is pd.NA or v != v else v for v in df[c].tolist()] for c in df.columns]
    return sorted(zip(*cells), key=repr) if cells else []


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    ka, kb = kinds(ours), kinds(theirs)
    # A column with NULLs may arrive as objects, or integers as floats, on one side only.
    same = all(ka[c] == kb[c] or "O" in (ka[c], kb[c]) or ours[c].isna().any() for c in ka)
    return "" if same else f"types {[(c, ka[c], kb[c]) for c in ka if ka[c] != kb[c]]}"


def main(names: list[str]) -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = query(spark, sf_dir).toPandas()
            mid = time.time()
            note = compare(ours, con.sql(sqls[name]).df()) if name in sqls else "rows only"
        except Exception as error:  # noqa: BLE001
            mid, note, ours = time.time(), f"ERROR {str(error)[:900]}", pd.DataFrame()
        failed = note not in ("", "rows only")
        bad += failed
        print(f"{'BAD' if failed else 'ok ':4}{name:28}{len(ours):8} rows {mid - start:6.2f}s {time.time() - mid:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
