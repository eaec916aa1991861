"""Row comparison shared by the oracle test and tools/oracle_check.py."""

import datetime
import decimal
import math


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare_rows(scols, srows, dcols, drows):
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        return True, f"n={len(a)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"spark={len(a)} duck={len(b)} first={diff}"
