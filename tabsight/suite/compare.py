"""Order-insensitive comparison of a Spark result with a DuckDB oracle result
(row count, column names, multiset of values with floats rounded)."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, digits)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(scols, srows, dcols, drows) -> list[str]:
    """Problems found (empty list = match)."""
    msgs = []
    if sorted(scols) != sorted(dcols):
        msgs.append(f"columns spark={scols} duck={dcols}")
    if len(srows) != len(drows):
        msgs.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not msgs:
        a, b = canon(scols, srows), canon(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msgs.append(f"values differ, e.g. {diff}")
    return msgs
