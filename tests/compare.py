"""Side-by-side run of registered queries and their SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def difference(con, spark, query, sql: str, sf_dir: str) -> str | None:
    """None when both give the same columns and rows, else a short description."""
    frame = query(spark, sf_dir)
    names, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected_names, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}; " + _sample(got, expected)
    if got != expected:
        return _sample(got, expected)
    wrong = _kinds(dict(frame.dtypes), kinds)
    return f"types {wrong}" if wrong else None


_SAME = {
    "string": ("VARCHAR",),
    "bigint": ("BIGINT", "HUGEINT", "UBIGINT"),
    "int": ("INTEGER",),
    "double": ("DOUBLE",),
    "boolean": ("BOOLEAN",),
    "date": ("DATE", "TIMESTAMP"),
    "timestamp": ("TIMESTAMP", "TIMESTAMP WITH TIME ZONE"),
    "timestamp_ntz": ("TIMESTAMP",),
}


def _kinds(ours: dict, theirs: dict) -> list:
    return [
        (c, ours[c], theirs[c]) for c in ours if not theirs[c].startswith(_SAME.get(ours[c], ("?",)))
    ]


def _sample(got, expected) -> str:
    left, right = set(got), set(expected)
    return f"only spark {list(left - right)[:2]} only sql {list(right - left)[:2]}"
