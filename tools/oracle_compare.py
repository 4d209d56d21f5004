"""Run registered queries in Spark and their oracle SQL in DuckDB on the
same parquet tables and compare row count, column names and values.

usage: python tools/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from jobsift.sources.tables import TABLES  # noqa: E402


EXACT = os.environ.get("ORACLE_EXACT") == "1"  # compare doubles bit for bit


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if EXACT else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if hasattr(v, "tolist"):
        return norm_value(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def spark_type_name(dt) -> str:
    """Spark type -> the DuckDB type name it should match."""
    from pyspark.sql import types as T
    simple = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
              T.FloatType: "FLOAT", T.StringType: "VARCHAR", T.DateType: "DATE",
              T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB", T.ShortType: "SMALLINT",
              T.TimestampType: "TIMESTAMP"}
    for k, v in simple.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.ArrayType):
        return spark_type_name(dt.elementType) + "[]"
    return dt.simpleString().upper()


def compare(spark, con, sf_dir, name, qfn, sql):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    res.update(duck_rows=len(drows), duck_sec=round(time.time() - t1, 2))
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS differ spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    stypes = {f.name: spark_type_name(f.dataType) for f in sdf.schema.fields}
    dtypes = {c: str(t) for c, t in zip(dcols, rel.types)}
    diff = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    if diff:
        res["types"] = diff
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        res["status"] = "match"
    else:
        sa, sb = set(a), set(b)
        res["status"] = "VALUES differ"
        res["only_spark"] = [str(x)[:300] for x in list(sa - sb)[:2]]
        res["only_duck"] = [str(x)[:300] for x in list(sb - sa)[:2]]
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    from jobsift.plans.catalog import oracle_sql, queries
    from jobsift.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, os_.get(name))
        except Exception as e:  # report and continue
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"done: {bad} problem(s)")


if __name__ == "__main__":
    main()
