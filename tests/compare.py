"""Run queries and their SQL side by side: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def difference(df, sql: str, con) -> str:
    """'' if both give the same rows under the same column names."""
    names = sorted(df.columns)
    result = con.execute(sql)
    other = [d[0] for d in result.description]
    if sorted(other) != names:
        return f"columns {names} against {sorted(other)}"
    order = [other.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).toLocalIterator())
    if ours == theirs:
        return ""
    return f"{ours.total()} rows against {theirs.total()}; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from corpuskiln.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    sql, bad, con = entry.oracle_sql(), 0, duck(folder)
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = query(spark, folder)
            said = difference(df, sql[name], con) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
