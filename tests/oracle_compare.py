"""Run a registered Spark query and its DuckDB oracle on the same tables and
compare row count, column names/types and an order-insensitive value hash.

CLI: python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        # STRICT=1 hashes the exact double (bitwise equality of both engines)
        return repr(v + 0.0) if os.environ.get("STRICT") else repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def frame_hash(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def kind(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("char", "string", "varchar")):
        return "str"
    if any(k in t for k in ("double", "float", "decimal", "real")):
        return "float"
    if any(k in t for k in ("int", "long", "short", "byte")):
        return "int"
    if "bool" in t:
        return "bool"
    return t


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_types = {f.name: kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    spdf = pd.DataFrame([r.asDict(recursive=True) for r in sdf.collect()], columns=sdf.columns)
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    dpdf = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    t2 = time.time()
    res = {
        "query": name,
        "rows_spark": len(spdf),
        "rows_duck": len(dpdf),
        "cols_match": sorted(s_types) == sorted(d_types),
        "types_match": s_types == d_types,
        "hash_match": False,
        "spark_s": round(t1 - t0, 2),
        "duck_s": round(t2 - t1, 2),
    }
    if res["cols_match"]:
        res["hash_match"] = frame_hash(spdf) == frame_hash(dpdf)
    if not res["types_match"]:
        res["types"] = {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types)
                        if s_types.get(k) != d_types.get(k)}
    return res


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from gradewise.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(oracle_sql())
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf_dir, n, qs[n], sqls[n])
        except Exception as e:  # noqa: BLE001
            r = {"query": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("hash_match") and r.get("rows_spark") == r.get("rows_duck") and r.get("types_match")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
