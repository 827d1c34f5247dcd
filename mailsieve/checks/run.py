"""Runs registered queries next to their SQL and compares the rows.

    python -m mailsieve.checks.run [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

from mailsieve.checks import load
from mailsieve.session import local_session


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, (str(d[1]) for d in cur.description)))
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if _KINDS.get(t, t) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs) if a != b), ("(length)", ""))
        return f"{len(ours)} vs {len(theirs)} rows; {str(first[0])[:700]}\n      {str(first[1])[:700]}"
    return None


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    queries, sqls = load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in names or queries:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, queries[name], sqls[name], sf_dir)
                n = ""
            else:
                n, problem = f" rows={queries[name](spark, sf_dir).count()} (no SQL)", None
        except Exception as e:
            n, problem = "", f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{n}{'' if problem is None else ' ' + problem}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
