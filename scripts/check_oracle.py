"""Run registered queries on Spark and their oracle SQL on DuckDB; compare the results.

usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from featpipe.queries import load_all  # noqa: E402
from featpipe.session import build_session  # noqa: E402
from featpipe.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type_as_duck(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type_as_duck(t[6:-1]) + "[]"
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return SPARK_TO_DUCK.get(t, t)


def kinds(cols, rows):
    """Python value type per column (first non-NULL value), by column name."""
    out = {}
    for i, c in enumerate(cols):
        k = None
        for r in rows:
            if r[i] is not None:
                v = r[i]
                k = type(v).__name__
                if isinstance(v, (list, tuple)) and v:
                    k += "[" + type(v[0]).__name__ + "]"
                break
        out[c] = k
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    extra = {}
    spark = build_session("local[8]", shuffle_partitions=8, extra=extra)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = q.fn(spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.oracle:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(q.oracle)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        st = {c: spark_type_as_duck(t) for c, t in df.dtypes}
        dt = {d[0]: str(d[1]).replace(" ", "") for d in res.description}
        bad_t = [f"{c}: spark={st[c]} duck={dt.get(c)}" for c in st if st[c].replace(" ", "") != dt.get(c)]
        if bad_t:
            print(f"SCHEMA {name}: " + ", ".join(bad_t))
        ks, kd = kinds(scols, srows), kinds(dcols, drows)
        kd = {c: ("list" + k[5:] if k and k.startswith("tuple") else k) for c, k in kd.items()}
        ks = {c: ("list" + k[5:] if k and k.startswith("tuple") else k) for c, k in ks.items()}
        if ks != kd:
            print(f"TYPE {name}: " + ", ".join(f"{c}: spark={ks[c]} duck={kd.get(c)}" for c in ks if ks[c] != kd.get(c)))
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} first diffs {diff}")
            bad += 1
        else:
            print(f"ok   {name}: {len(a)} rows ({ts:.1f}s)")
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
