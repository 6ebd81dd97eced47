"""Update documents: validation, application to Python documents, and the seed of an upsert."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from typing import Any

from docloom.errors import NotSupported, QueryError
from docloom.functions.matcher import holds, matches
from docloom.plans.filters import is_operators, is_regex, parse_conditions, parse_filter
from docloom.values import MISSING, compare, equal, inverted, is_number, order_key, sort_value_key

OPERATORS = ("$set", "$unset", "$inc", "$min", "$max", "$rename", "$setOnInsert", "$push", "$addToSet", "$pull")


@dataclass(frozen=True)
class Change:
    op: str
    path: tuple[str, ...]
    arg: Any


def parse_update(update: Any) -> list[Change]:
    """Changes sorted by path; overlapping paths are rejected."""
    if not isinstance(update, dict) or not update:
        raise QueryError(9, "the update document must have at least one operator")
    changes = []
    for op, fields in update.items():
        if not op.startswith("$"):
            raise QueryError(9, "the update document must hold operators only")
        if op not in OPERATORS:
            raise NotSupported(f"the update operator {op}")
        if not isinstance(fields, dict):
            raise QueryError(9, f"Modifiers operate on fields but we found another type: {op}")
        for name, arg in fields.items():
            path = split_path(name)
            if op == "$inc" and not is_number(arg):
                raise QueryError(14, f"Cannot increment with non-numeric argument: {name}")
            if op == "$rename":
                if not isinstance(arg, str):
                    raise QueryError(2, "The 'to' field for $rename must be a string")
                target = split_path(arg)
                if target[: len(path)] == path or path[: len(target)] == target:
                    raise QueryError(2, "The source and target field for $rename must not be on the same path")
                changes.append(Change("$rename", path, target))
                changes.append(Change("$renamed", target, path))
                continue
            if op == "$push":
                arg = push_spec(arg)
            elif op == "$addToSet":
                arg = each_spec(arg, "$addToSet", ("$each",))["$each"]
            elif op == "$pull":
                arg = pull_test(arg)
            changes.append(Change(op, path, arg))
    changes.sort(key=lambda c: c.path)
    for a, b in zip(changes, changes[1:]):
        if b.path[: len(a.path)] == a.path:
            raise QueryError(40, f"Updating the path '{'.'.join(b.path)}' would create a conflict at '{'.'.join(a.path)}'")
    return changes


def split_path(name: str) -> tuple[str, ...]:
    path = tuple(name.split("."))
    if not all(path):
        raise QueryError(56, f"The update path '{name}' contains an empty field name")
    if any(p == "$" or p.startswith("$[") for p in path):
        raise NotSupported("a positional update path")
    return path


def each_spec(arg: Any, op: str, known: tuple[str, ...]) -> dict:
    if not isinstance(arg, dict) or "$each" not in arg:
        return {"$each": [arg]}
    for k in arg:
        if k not in known:
            raise QueryError(2, f"Unrecognized clause in {op}: {k}")
    if not isinstance(arg["$each"], list):
        raise QueryError(2, f"The argument to $each in {op} must be an array")
    return arg


def push_spec(arg: Any) -> dict:
    spec = each_spec(arg, "$push", ("$each", "$position", "$slice", "$sort"))
    for k in ("$position", "$slice"):
        if k in spec and (isinstance(spec[k], bool) or not isinstance(spec[k], (int, float)) or spec[k] != int(spec[k])):
            raise QueryError(2, f"The value for {k} must be an integer value")
    sort = spec.get("$sort")
    if sort is not None and not (sort in (1, -1) or (isinstance(sort, dict) and sort and all(v in (1, -1) for v in sort.values()))):
        raise QueryError(2, "The $sort must be 1, -1 or a document of these")
    return spec


def pull_test(arg: Any):
    if is_regex(arg) or is_operators(arg):
        return ("conds", parse_conditions(arg))
    if isinstance(arg, dict):
        return ("filter", parse_filter(arg))
    return ("value", arg)


def pulled(test: tuple, element: Any) -> bool:
    kind, arg = test
    if kind == "value":
        return equal(element, arg)
    if kind == "filter":
        return isinstance(element, dict) and matches(element, arg)
    return all(holds([(element, False)], c) for c in arg)


def apply_update(doc: dict, changes: list[Change], inserting: bool = False) -> dict:
    """The changed copy of a document. A change of _id is rejected."""
    out = copy.deepcopy(doc)
    for c in changes:
        if c.op == "$setOnInsert" and not inserting:
            continue
        if c.op == "$renamed":
            value = get_path(doc, c.arg)
            if value is not MISSING:
                set_path(out, c.path, copy.deepcopy(value))
            continue
        old = get_path(out, c.path, strict=c.op == "$rename")
        new = changed(c, old)
        if new is MISSING:
            unset_path(out, c.path)
        elif old is MISSING or new is not old:
            set_path(out, c.path, new)
    if not inserting and not equal(doc.get("_id", MISSING), out.get("_id", MISSING)):
        raise QueryError(66, "Performing an update on the path '_id' would modify the immutable field '_id'")
    return out


def changed(c: Change, old: Any) -> Any:
    name = ".".join(c.path)
    if c.op in ("$set", "$setOnInsert"):
        return copy.deepcopy(c.arg)
    if c.op in ("$unset", "$rename"):
        return MISSING
    if c.op == "$inc":
        if old is MISSING:
            return c.arg
        if not is_number(old):
            raise QueryError(14, f"Cannot apply $inc to a value of non-numeric type: {name}")
        return old + c.arg
    if c.op in ("$min", "$max"):
        if old is MISSING:
            return copy.deepcopy(c.arg)
        order = compare(c.arg, old)
        return copy.deepcopy(c.arg) if (order < 0 if c.op == "$min" else order > 0) else old
    if old is MISSING:
        if c.op == "$pull":
            return MISSING
        old = []
    if not isinstance(old, list):
        raise QueryError(2, f"The field '{name}' must be an array")
    if c.op == "$pull":
        return [x for x in old if not pulled(c.arg, x)]
    if c.op == "$addToSet":
        out = list(old)
        for x in c.arg:
            if not any(equal(x, y) for y in out):
                out.append(copy.deepcopy(x))
        return out
    at = c.arg.get("$position", len(old))
    at = max(0, len(old) + at) if at < 0 else min(at, len(old))
    out = old[:at] + copy.deepcopy(c.arg["$each"]) + old[at:]
    sort = c.arg.get("$sort")
    if isinstance(sort, dict):
        for path, direction in reversed(sort.items()):
            parts = path.split(".")
            out.sort(key=lambda x: element_key(x, parts, direction == -1))
    elif sort is not None:
        out.sort(key=lambda x: inverted(order_key(x)) if sort == -1 else order_key(x))
    if "$slice" in c.arg:
        n = int(c.arg["$slice"])
        out = out[:n] if n >= 0 else out[n:]
    return out


def element_key(x: Any, path: list[str], descending: bool) -> bytes:
    v = x
    for name in path:
        v = v.get(name, MISSING) if isinstance(v, dict) else MISSING
    key = sort_value_key([v], descending)
    return inverted(key) if descending else key


def get_path(doc: Any, path: tuple[str, ...], strict: bool = False) -> Any:
    for name in path:
        if isinstance(doc, dict):
            doc = doc.get(name, MISSING)
        elif isinstance(doc, list) and name.isdigit():
            if strict:
                raise QueryError(2, "The source field cannot be an array element")
            doc = doc[int(name)] if int(name) < len(doc) else MISSING
        else:
            return MISSING
        if doc is MISSING:
            return MISSING
    return doc


def set_path(doc: Any, path: tuple[str, ...], value: Any) -> None:
    for i, name in enumerate(path):
        last = i == len(path) - 1
        if isinstance(doc, list):
            if not name.isdigit():
                raise QueryError(28, f"Cannot create field '{name}' in an array")
            at = int(name)
            doc.extend([None] * (at + 1 - len(doc)))
            if last:
                doc[at] = value
            else:
                if doc[at] is None:
                    doc[at] = {}
                doc = doc[at]
        elif isinstance(doc, dict):
            if last:
                doc[name] = value
            else:
                doc = doc.setdefault(name, {})
        else:
            raise QueryError(28, f"Cannot create field '{name}' in a value that is neither a document nor an array")


def unset_path(doc: Any, path: tuple[str, ...]) -> None:
    parent = get_path(doc, path[:-1])
    if isinstance(parent, dict):
        parent.pop(path[-1], None)
    elif isinstance(parent, list) and path[-1].isdigit() and int(path[-1]) < len(parent):
        parent[int(path[-1])] = None


def upsert_seed(filter_: dict) -> dict:
    """The literal equality fields of a filter, dotted ones nested."""
    out: dict = {}
    for key, v in filter_.items():
        if not key.startswith("$") and not is_regex(v) and not is_operators(v):
            set_path(out, split_path(key), copy.deepcopy(v))
    return out


def upserted(filter_: dict, changes: list[Change], new_id: Any) -> dict:
    doc = apply_update(upsert_seed(filter_), changes, inserting=True)
    identity = doc.pop("_id") if "_id" in doc else new_id
    return {"_id": identity, **doc}
