"""Comparison of a Spark result with a DuckDB result, row by row, whatever their order."""

import numpy as np
import pandas as pd


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    return str(x)


def rows_of(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(_plain(x) for x in row)) for row in frame[columns].itertuples(index=False, name=None))


def same(spark_frame, duck_frame) -> None:
    a, b = spark_frame.toPandas(), duck_frame
    assert sorted(a.columns) == sorted(b.columns)
    left, right = rows_of(a), rows_of(b)
    assert len(left) == len(right)
    assert left == right
