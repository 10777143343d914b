"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    return {"bigint": "int", "integer": "int", "varchar": "string", "float": "double"}.get(name, name)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def differences(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    result = con.execute(sql)
    sql_names = [c[0] for c in result.description]
    names = sorted(df.columns)
    if names != sorted(sql_names):
        return [f"columns {names} != {sorted(sql_names)}"]
    sql_kinds = {c[0]: _kind(str(c[1])) for c in result.description}
    kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    if kinds != sql_kinds:
        return [f"types {kinds} != {sql_kinds}"]
    got = _sorted(df.select(*[f"`{n}`" for n in names]).collect())
    order = [sql_names.index(n) for n in names]
    want = _sorted([row[i] for i in order] for row in result.fetchall())
    problems = []
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, SQL has {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return problems


def main(sf: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from vitrina.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = sql_connection(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = differences(spark, con, fn, sqls[name], sf_dir)
            else:
                problems = [] if fn(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - reported, the others still run
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        note = "" if name in sqls else " (no SQL)"
        print(f"{'FAIL' if problems else 'ok'} {name}{note} {time.time() - start:.1f}s", *problems)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
