"""Order-insensitive comparison of Arrow tables from both engines."""

from __future__ import annotations


def shown(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shown(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows(table) -> list[str]:
    names = sorted(table.column_names)
    columns = [table.column(c).to_pylist() for c in names]
    return sorted("|".join(map(shown, r)) for r in zip(*columns, strict=True))


def duck_table(con, sql):
    out = con.sql(sql).arrow()
    return out.read_all() if hasattr(out, "read_all") else out
