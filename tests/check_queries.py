"""Run registered queries against their SQL on one scale: python tests/check_queries.py DIR [names]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from panelwright.session import local_session  # noqa: E402


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.date().isoformat()
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        value = value.item() if hasattr(value, "item") else value
        return float(value) + 0.0 if not isinstance(value, (bool, str)) else value
    return value


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when rows and column names agree, else what differs."""
    return difference(entry.queries()[name](spark, folder), con, name)


def difference(built, con, name: str) -> str:
    ours = built.toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ""
    theirs = con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(set(ours.column_names) ^ set(theirs.column_names))}"
    kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in sorted(ours.column_names)]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} columns {sorted(ours.column_names)}"
    return f"TYPES {odd}" if odd else ""


if __name__ == "__main__":
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    for name in entry.queries():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            found = compare(spark, con, name, folder)
        except Exception as error:  # a broken query must not hide the others
            found = f"ERROR {str(error)[:600]}"
        print(f"{name}: {found or 'ok'} ({time.time() - started:.1f}s)", flush=True)
