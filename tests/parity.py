"""Compare a DataFrame with the rows of its SQL oracle, order aside."""

import os

import duckdb

from quern.tables import TABLES


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        files = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        db.sql(f"create view {name} as select * from '{files}'")
    return db


def _plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)
