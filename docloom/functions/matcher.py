"""Exact filter evaluation on Python documents: the dynamic profile's residual, $pull, catalog filters and test oracle."""

from __future__ import annotations

from typing import Any

from docloom.plans.filters import Cond, Field, Logical, Regex, parse_filter
from docloom.values import MISSING, bracket, compare, equal, type_code


def branches(value: Any, path: tuple[str, ...]) -> list[tuple[Any, bool]]:
    """(value, whole) for every way the path can go; MISSING where a document or scalar lacks it. whole: reached by a position, so an array there is one value."""
    if not path:
        return [(value, False)]
    name, rest = path[0], path[1:]
    if isinstance(value, dict):
        return branches(value[name], rest) if name in value else [(MISSING, False)]
    if not isinstance(value, list):
        return [(MISSING, False)]
    out = []
    if name.isdigit() and str(int(name)) == name and int(name) < len(value):
        out += branches(value[int(name)], rest) if rest else [(value[int(name)], True)]
    for element in value:
        if isinstance(element, dict):
            out += branches(element, path)
    if name.isdigit() and any(v is not MISSING for v, _ in out):
        out = [x for x in out if x[0] is not MISSING]
    return out


def matches(doc: Any, node) -> bool:
    if isinstance(node, dict) or node is None:
        node = parse_filter(node)
    if isinstance(node, Logical):
        if node.op == "$and":
            return all(matches(doc, p) for p in node.parts)
        found = any(matches(doc, p) for p in node.parts)
        return found if node.op == "$or" else not found
    values = branches(doc, node.path)
    return all(holds(values, c) for c in node.conds)


def spread(values: list[tuple[Any, bool]]) -> list[Any]:
    """The values, and the elements of arrays that aren't taken as a whole."""
    out = []
    for v, whole in values:
        out.append(v)
        if isinstance(v, list) and not whole:
            out += v
    return out


def holds(values: list[tuple[Any, bool]], c: Cond) -> bool:
    op, arg = c.op, c.arg
    if op == "$never":
        return False
    if op == "$ne":
        return not holds(values, Cond("$eq", arg))
    if op == "$nin":
        return not holds(values, Cond("$in", arg))
    if op == "$not":
        return not all(holds(values, x) for x in arg)
    if op == "$all":
        return bool(arg) and all(holds(values, x) for x in arg)
    if op == "$exists":
        return any(v is not MISSING for v, _ in values) == arg
    if op == "$size":
        return any(isinstance(v, list) and len(v) == arg for v, _ in values)
    if op == "$elemMatch":
        return any(isinstance(v, list) and any(all(holds([(e, True)], x) for x in arg) for e in v) for v, _ in values)
    if op == "$elemMatchDoc":
        return any(isinstance(v, list) and any(isinstance(e, dict) and matches(e, arg) for e in v) for v, _ in values)
    if op == "$in":
        return any(holds(values, Cond("$regex", x) if isinstance(x, Regex) else Cond("$eq", x)) for x in arg)
    found = spread(values)
    if op == "$eq":
        return any(v is MISSING or v is None for v in found) if arg is None else any(v is not MISSING and equal(v, arg) for v in found)
    if op == "$type":
        return any(v is not MISSING and type_code(v) in arg for v in found)
    if op == "$regex":
        pattern = arg.compiled()
        return any(isinstance(v, str) and pattern.search(v) is not None for v in found)
    return any(in_range(v, op, arg) for v in found)


def in_range(v: Any, op: str, bound: Any) -> bool:
    if v is MISSING or v is None or bracket(v) != bracket(bound):
        return False
    if v != v or bound != bound:  # NaN equals itself only
        return op in ("$gte", "$lte") and v != v and bound != bound
    order = compare(v, bound)
    return {"$gt": order > 0, "$gte": order >= 0, "$lt": order < 0, "$lte": order <= 0}[op]


__all__ = ["Field", "branches", "holds", "matches"]
