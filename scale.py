"""Copy a folder of tables several times over with shifted keys: ``python scale.py SRC DST COPIES``.

Joins stay valid, since every key is shifted by the same step wherever it
"""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

# the keys of each table, and the table and column that their step is taken from
KEYS = {
    "customer": {"c_custkey": ("customer", "c_custkey")},
    "supplier": {"s_suppkey": ("supplier", "s_suppkey")},
    "part": {"p_partkey": ("part", "p_partkey")},
    "orders": {"o_orderkey": ("orders", "o_orderkey"), "o_custkey": ("customer", "c_custkey")},
    "lineitem": {
        "l_orderkey": ("orders", "o_orderkey"),
        "l_partkey": ("part", "p_partkey"),
        "l_suppkey": ("supplier", "s_suppkey"),
    },
    "events": {"event_id": ("events", "event_id"), "user_id": ("customer", "c_custkey")},
    "documents": {"doc_id": ("documents", "doc_id")},
    "labels": {"doc_id": ("documents", "doc_id")},
    "embeddings": {"vec_id": ("embeddings", "vec_id")},
    "pages": {"page_id": ("pages", "page_id")},
    "conversations": {"conv_id": ("conversations", "conv_id")},
    "benchmark": {},
    "region": {},
    "nation": {},
}


def main(src: str, dst: str, copies: int) -> None:
    Path(dst).mkdir(parents=True)
    con = duckdb.connect()
    for name, keys in KEYS.items():
        shifted = [f"{c} + k * (select max({key}) + 1 from '{src}/{table}.parquet') as {c}" for c, (table, key) in keys.items()]
        columns = f"* replace ({', '.join(shifted)})" if shifted else "*"
        times = copies if shifted else 1
        rows = f"select {columns} exclude (k)" if not shifted else f"select {columns.replace('*', '* exclude (k)', 1)}"
        con.execute(f"copy ({rows} from '{src}/{name}.parquet', range({times}) r(k)) to '{dst}/{name}.parquet' (format parquet)")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]))
