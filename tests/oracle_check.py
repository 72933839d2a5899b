"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(type_name):
    t = str(type_name).lower()
    for short, names in {
        "int": ("int", "long", "short", "byte"),
        "double": ("double", "float", "decimal"),
        "string": ("string", "varchar"),
        "timestamp": ("timestamp",),
        "date": ("date",),
        "boolean": ("boolean",),
    }.items():
        if any(n in t for n in names) and "[" not in t and "array" not in t:
            return short
    return "nested"


def canonical(rows):
    return sorted([tuple(map(repr, r)) for r in rows])


def compare(spark_df, con, sql):
    names = sorted(spark_df.columns)
    described = {d[0]: d[1] for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns differ: {names} vs {sorted(described)}"
    columns = ", ".join(f'"{n}"' for n in names)
    expected = con.execute(f"SELECT {columns} FROM ({sql})").fetchall()
    kinds = dict(spark_df.dtypes)
    for n in names:
        a, b = kind(kinds[n]), kind(described[n])
        if a != b or "huge" in str(described[n]).lower():
            return f"type of {n}: {kinds[n]} vs {described[n]}"
    want = canonical(expected)
    got = canonical(tuple(r) for r in spark_df.select(*names).collect())
    if len(want) != len(got):
        return f"rows: spark {len(got)} sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n   {names}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None if want else "no rows"


def main():
    from cellpulse.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.2f}s {'' if name in oracle else '(no SQL)'} {problem or ''}",
              flush=True)
    print("failed:", failed, "of", len(wanted), "| without SQL:", sorted(set(queries) - set(oracle)))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
