"""Filter trees compiled to Column predicates: comparison, membership, containment, existence and their combinations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}


def path(field: str, column: str | None) -> Column:
    """A column, or a value inside a JSON column."""
    return F.get_json_object(column, "$." + field) if column else F.col(field)


def compile_filter(tree: dict[str, Any], json_column: str | None = None, arrays: tuple[str, ...] = ()) -> Column:
    """``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}``, ``{field: value}`` or ``{field: {operator: value}}``.

    Operators: eq, ne, gt, lt, gte, lte, in, contains, like, exists. Several fields of one object must all hold. A missing
    field, and a comparison of a value that is no number, is false. Of a field named in ``arrays``, contains and eq look for an
    element, and in for any of several; other fields may be paths into structs. Unknown operators raise ValueError.
    """
    out = F.lit(True)
    for key, value in tree.items():
        if key in ("and", "or"):
            parts = [compile_filter(t, json_column, arrays) for t in value]
            one = F.lit(key == "and")
            for p in parts:
                one = one & p if key == "and" else one | p
        elif key == "not":
            one = ~compile_filter(value, json_column, arrays)
        else:
            c = path(key, json_column)
            one = F.lit(True)
            for op, v in (value if isinstance(value, dict) else {"eq": value}).items():
                op = op.lstrip("$")
                if key in arrays and op in ("eq", "contains", "in"):
                    p = F.arrays_overlap(c, F.array(*(F.lit(x) for x in (v if op == "in" else [v]))))
                elif op == "eq":
                    p = c == F.lit(v) if json_column is None else c == F.lit(str(v))
                elif op == "ne":
                    p = c != F.lit(v) if json_column is None else c != F.lit(str(v))
                elif op in NUMERIC:
                    p = NUMERIC[op](c.try_cast("double"), F.lit(float(v)))
                elif op == "in":
                    p = c.isin([str(x) for x in v] if json_column else list(v))
                elif op == "contains":
                    p = F.contains(F.lower(c), F.lit(str(v).lower()))
                elif op == "like":
                    p = c.ilike(v)
                elif op == "exists":
                    p = c.isNotNull() == F.lit(bool(v))
                else:
                    raise ValueError(f"unknown operator {op}")
                one = one & F.coalesce(p, F.lit(False))
        out = out & one
    return out


def in_scopes(c: Column, scopes: list[str] | None) -> Column:
    """No scopes given: everything; an empty list: nothing."""
    return F.lit(True) if scopes is None else c.isin(scopes) if scopes else F.lit(False)
