import datetime as dt
import math
from collections import Counter


def at(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def bag(names, rows):
    """Rows as a multiset, columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def rows_of(df, *cols):
    picked = df.select(*cols) if cols else df
    return [tuple(r) for r in picked.collect()]


def unordered(rows):
    return sorted(rows, key=str)


def by_key(df, key="plot_id"):
    return {r[key]: r.asDict() for r in df.collect()}
