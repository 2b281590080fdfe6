"""python tests/check_parity.py SF_DIR [NAME...]: each query against its SQL in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f'{p}/*.parquet' if p.is_dir() else p}')")
    return con


def normal(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 5)
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def rows(cols, data):  # noqa: ANN001, ANN201
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([tuple(normal(r[k]) for k in order) for r in data], key=repr), sorted(cols)


def compare(spark, con, name, f, sql, sf_dir):  # noqa: ANN001, ANN201
    """None if both agree, else what differs."""
    df = f(spark, sf_dir)
    a, ca = rows(df.columns, df.collect())
    if sql is None:
        return None
    res = con.execute(sql)
    b, cb = rows([d[0] for d in res.description], res.fetchall())
    if ca != cb or len(a) != len(b):
        return f"{ca} {len(a)} rows; SQL {cb} {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    q, o, con, bad = e.queries(), e.oracle_sql(), connect(sf), 0
    for name in names or q:
        t = time.time()
        try:
            why = compare(spark, con, name, q[name], o.get(name), sf)
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:500]}"
        bad += why is not None
        print(f"{name}: {'ok' if why is None else why} ({'SQL' if name in o else 'no SQL'}, {time.time() - t:.1f} s)", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
