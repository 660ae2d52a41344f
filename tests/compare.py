"""Compare a registered query with its SQL statement on one data folder."""

from __future__ import annotations

import os
import re

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t)}.parquet')")
    return con


def kind(dtype: str) -> str:
    dtype = re.sub(r"\(.*", "", dtype.lower())
    return {
        "integer": "int", "bigint": "bigint", "double": "double", "varchar": "string",
        "hugeint": "hugeint",
    }.get(dtype, dtype)


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:19])
            df[c] = df[c].where(df[c].isna() | ~df[c].astype(str).str.match(r"^\d{4}-\d\d-\d\d 00:00:00$"),
                                df[c].astype(str).str[:10])
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True)


def differences(spark_df, con, sql: str, loose: bool = False) -> list[str]:
    relation = con.sql(sql)
    left_types = {n: kind(t) for n, t in spark_df.dtypes}
    right_types = {n: kind(str(t)) for n, t in zip(relation.columns, relation.types)}
    problems = []
    if left_types != right_types:
        for n in sorted(set(left_types) | set(right_types)):
            if left_types.get(n) != right_types.get(n):
                problems.append(f"type {n}: {left_types.get(n)} / {right_types.get(n)}")
    left, right = canonical(spark_df.toPandas()), canonical(relation.df())
    if list(left.columns) != list(right.columns):
        return [*problems, f"columns {list(left.columns)} / {list(right.columns)}"]
    if len(left) != len(right):
        return [*problems, f"rows {len(left)} / {len(right)}"]
    for c in left.columns:
        a, b = left[c], right[c]
        if pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b):
            same = np.isclose(a, b, rtol=0 if not loose else 1e-9, atol=0 if not loose else 1e-5, equal_nan=True)
        else:
            same = (a.fillna("∅").astype(str) == b.fillna("∅").astype(str)).to_numpy()
        if not same.all():
            i = int(np.argmin(same))
            problems.append(f"value {c}: {int((~same).sum())} differ, first {a[i]!r} / {b[i]!r}")
    return problems
