"""Run registered queries next to their SQL and report differences.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v) -> str:
    if v is None or v != v:
        return "∅"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if isinstance(v, dict):
        return str({k: cell(x) for k, x in v.items()})
    return repr(v)


def canonical(table: pa.Table) -> list[tuple]:
    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    return str(t)


def kinds(table: pa.Table) -> dict[str, str]:
    return {f.name: kind(f.type) for f in sorted(table.schema, key=lambda f: f.name)}


def difference(got: pa.Table, want: pa.Table) -> str | None:
    a, b = kinds(got), kinds(want)
    if list(a) != list(b):
        return f"columns {list(a)} != {list(b)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    x, y = canonical(got), canonical(want)
    if x != y:
        only_got, only_want = sorted(set(x) - set(y)), sorted(set(y) - set(x))
        return (f"{len(only_got)} of {len(x)} rows differ over {list(a)}: "
                f"{only_got[:2]} != {only_want[:2]}")
    if a != b and got.num_rows:
        return f"types {[(c, a[c], b[c]) for c in a if a[c] != b[c]]}"
    return None


def main(argv: list[str]) -> int:
    from overstats import catalog
    from overstats.session import session

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    catalog.load()
    names = argv[1:] or list(catalog.QUERIES)
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = catalog.QUERIES[name](spark, folder).toArrow()
            took = time.time() - start
            if name in catalog.ORACLE:
                problem = difference(got, con.execute(catalog.ORACLE[name]).to_arrow_table())
            else:
                problem = None
            note = "" if name in catalog.ORACLE else " (rows only)"
            print(f"{'FAIL' if problem else 'ok'}{note} {name} rows={got.num_rows} {took:.1f}s", flush=True)
            if problem:
                bad += 1
                print("   ", problem[:900], flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"ERROR {name}: {str(error)[:500]}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
