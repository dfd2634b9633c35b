"""Run registered queries against their SQL twins: ``python -m checks.compare [names...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v: object) -> object:
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    return float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """``""`` when both sides agree, else what differs; queries without a twin only run."""
    from checks.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if got else "no rows"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        diff = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}: {str(diff)[:1500]}"
    if not got:
        return "both empty"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ: {str(bad[0])[:1500]}" if bad else ""


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("CHECK_MASTER", "local[8]"))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    from checks.catalog import QUERIES

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = session(), duck(sf_dir), 0
    deadline = time.time() + float(os.environ.get("CHECK_SECONDS", "3600"))
    for name in argv or list(QUERIES):
        if time.time() > deadline:
            print("out of time before", name)
            return 1
        start = time.time()
        try:
            note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            note = f"ERROR {str(e)[:1200]}" if not os.environ.get("CHECK_TRACE") else traceback.format_exc()
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok':4} {name:28} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
