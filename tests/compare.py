"""Comparison of a Spark result with a DuckDB result, whatever the order of rows and columns."""

from collections import Counter

import pandas as pd


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return str(v)[:26] if hasattr(v, "isoformat") else v


def same(df, wanted: pd.DataFrame) -> None:
    got = df.toPandas()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: Counter(tuple(plain(v) for v in r) for r in x[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(wanted)
