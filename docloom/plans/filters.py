"""Filter documents -> a validated tree, with cheap simplifications."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import regex

from docloom.errors import NotSupported, QueryError
from docloom.values import NUMBER_CODES, TYPE_CODES, bracket, compare

COMPARISONS = {"$gt", "$gte", "$lt", "$lte"}
UNSUPPORTED = {"$mod", "$expr", "$where", "$text", "$jsonSchema", "$geoWithin", "$geoIntersects", "$near", "$nearSphere", "$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear", "$comment"}


@dataclass(frozen=True)
class Regex:
    source: str
    flags: str = ""

    def compiled(self) -> regex.Pattern:
        r"""The pattern for Python: $ is the end of the input only, \w, \d and \b are ASCII, \s is Unicode."""
        found = 0
        for flag in self.flags:
            found |= {"i": regex.I, "m": regex.M, "s": regex.S}[flag]
        return regex.compile(python_pattern(self.source, self.flags), found)


@dataclass(frozen=True)
class Cond:
    op: str
    arg: Any = None


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    conds: tuple[Cond, ...]


@dataclass(frozen=True)
class Logical:
    op: str  # $and, $or, $nor
    parts: tuple


ALWAYS, NEVER = Logical("$and", ()), Logical("$or", ())


#: The members of the classes outside and inside of brackets.
WORD, BOUNDARY = "A-Za-z0-9_", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
OUTSIDE = {"w": f"[{WORD}]", "W": f"[^{WORD}]", "d": "[0-9]", "D": "[^0-9]", "b": BOUNDARY, "B": f"(?!{BOUNDARY})"}
INSIDE = {"w": WORD, "W": r"\x00-/:-@\[-\^`{-\U0010ffff", "d": "0-9", "D": r"\x00-/:-\U0010ffff"}


def python_pattern(source: str, flags: str) -> str:
    r"""A JavaScript-style pattern for Python: classes are ASCII but for \s; without m $ is the very end, without s a dot is no line end."""
    out, escaped, inside = [], False, False
    for c in source:
        if escaped:
            escaped = False
            out[-1] = (INSIDE if inside else OUTSIDE).get(c, "\\" + c)
        elif c == "\\":
            escaped = True
            out.append(c)
        elif inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "$" and "m" not in flags:
            out.append(r"\Z")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r\u2028\u2029]")
        else:
            out.append(c)
    return "".join(out)


def regex_of(value: Any, options: Any = None) -> Regex:
    if isinstance(value, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if value.flags & bit)
        source = value.pattern
    elif isinstance(value, Regex):
        source, flags = value.source, value.flags
    elif isinstance(value, str):
        source, flags = value, ""
    else:
        raise QueryError(2, "$regex has to be a string")
    if options is not None:
        if not isinstance(options, str):
            raise QueryError(2, "$options has to be a string")
        if flags and options:
            raise QueryError(51075, "options set in both $regex and $options")
        flags = options or flags
    bad = set(flags) - set("imsu")
    if bad:
        raise NotSupported(f"the regular expression option {sorted(bad)[0]!r}")
    try:
        regex.compile(python_pattern(source, "m"))
    except regex.error as e:
        raise QueryError(51091, f"Regular expression is invalid: {e}") from None
    return Regex(source, "".join(sorted(set(flags) - {"u"})))


def is_regex(v: Any) -> bool:
    return isinstance(v, (re.Pattern, Regex))


def parse_filter(filter_: Any):
    """Validate a whole filter document."""
    if filter_ is None:
        filter_ = {}
    if not isinstance(filter_, dict):
        raise QueryError(2, "the filter has to be a document")
    parts = []
    for key, arg in filter_.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(arg, list) or not arg:
                raise QueryError(2, f"{key} argument must be a nonempty array")
            if not all(isinstance(x, dict) for x in arg):
                raise QueryError(2, f"{key} entries need to be full objects")
            parts.append(Logical(key, tuple(parse_filter(x) for x in arg)))
        elif key.startswith("$"):
            if key in UNSUPPORTED:
                raise NotSupported(key)
            raise QueryError(2, f"unknown top level operator: {key}")
        else:
            parts.append(Field(tuple(key.split(".")), parse_conditions(arg)))
    return parts[0] if len(parts) == 1 else Logical("$and", tuple(parts))


def is_operators(arg: Any) -> bool:
    return isinstance(arg, dict) and bool(arg) and next(iter(arg)).startswith("$")


def parse_conditions(arg: Any) -> tuple[Cond, ...]:
    """The conditions on one field: a value, a regular expression, or a document of operators."""
    if is_regex(arg):
        return (Cond("$regex", regex_of(arg)),)
    if not is_operators(arg):
        return (Cond("$eq", arg),)
    out = []
    for op, x in arg.items():
        if op == "$options":
            if "$regex" not in arg:
                raise QueryError(2, "$options needs a $regex")
        elif op == "$regex":
            out.append(Cond("$regex", regex_of(x, arg.get("$options"))))
        else:
            out.append(parse_operator(op, x))
    return tuple(out)


def parse_operator(op: str, x: Any) -> Cond:
    if op in ("$eq", "$ne"):
        if op == "$ne" and is_regex(x):
            raise QueryError(2, "Can't have regex as arg to $ne.")
        return Cond("$never") if is_regex(x) else Cond(op, x)
    if op in COMPARISONS:
        if x is None:
            return Cond("$eq", None) if op in ("$gte", "$lte") else Cond("$never")
        if bracket(x) is None:
            raise NotSupported(f"{op} with a {type(x).__name__}")
        return Cond(op, x)
    if op in ("$in", "$nin"):
        if not isinstance(x, list):
            raise QueryError(2, f"{op} needs an array")
        if any(is_operators(v) for v in x):
            raise QueryError(2, f"cannot nest $ under {op}")
        return Cond(op, tuple(regex_of(v) if is_regex(v) else v for v in x))
    if op == "$exists":
        return Cond(op, bool(x))
    if op == "$type":
        return Cond(op, frozenset().union(*(type_codes(v) for v in (x if isinstance(x, list) else [x]))))
    if op == "$size":
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x):
            raise QueryError(2, f"Failed to parse $size. Expected an integer: {x!r}")
        if x < 0:
            raise QueryError(2, f"Failed to parse $size. Expected a non-negative number: {x!r}")
        return Cond(op, int(x))
    if op == "$not":
        if is_regex(x):
            return Cond(op, (Cond("$regex", regex_of(x)),))
        if not is_operators(x):
            raise QueryError(2, "$not needs a regex or a document of operators")
        return Cond(op, parse_conditions(x))
    if op == "$all":
        if not isinstance(x, list):
            raise QueryError(2, "$all needs an array")
        elems = [isinstance(v, dict) and "$elemMatch" in v for v in x]
        if any(elems) and not all(elems):
            raise QueryError(2, "no mixing of $elemMatch and values in $all")
        if not any(elems) and any(is_operators(v) for v in x):
            raise QueryError(2, "no $ expressions in $all")
        return Cond(op, tuple(c for v in x for c in parse_conditions(v)))
    if op == "$elemMatch":
        if not isinstance(x, dict):
            raise QueryError(2, "$elemMatch needs an Object")
        first = next(iter(x), "")
        if first.startswith("$") and first not in ("$and", "$or", "$nor"):
            return Cond("$elemMatch", parse_conditions(x))
        return Cond("$elemMatchDoc", parse_filter(x))
    if op in UNSUPPORTED:
        raise NotSupported(op)
    raise QueryError(2, f"unknown operator: {op}")


def type_codes(v: Any) -> frozenset[int]:
    if v == "number":
        return frozenset(NUMBER_CODES)
    if isinstance(v, str) and v in TYPE_CODES:
        return frozenset([TYPE_CODES[v]])
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v in TYPE_CODES.values():
        return frozenset([int(v)])
    raise QueryError(2, f"Unknown type name alias or invalid type code: {v!r}")


def simplify(node):
    """Empty intersections and empty lists -> NEVER, repeated members of $in out, nested $and flattened. Only for single-valued fields."""
    if isinstance(node, Field):
        conds = []
        for c in node.conds:
            if c.op == "$never" or (c.op == "$in" and not c.arg) or (c.op == "$all" and not c.arg):
                return NEVER
            conds.append(Cond(c.op, tuple(dict.fromkeys(c.arg))) if c.op == "$in" and all(type(v) in (str, int) for v in c.arg) else c)
        return Field(node.path, tuple(conds))
    parts = [simplify(p) for p in node.parts]
    if node.op == "$and":
        if NEVER in parts:
            return NEVER
        flat = [q for p in parts for q in (p.parts if isinstance(p, Logical) and p.op == "$and" else (p,))]
        return flat[0] if len(flat) == 1 else Logical("$and", tuple(flat))
    if node.op == "$or":
        parts = [p for p in parts if p != NEVER]
        return parts[0] if len(parts) == 1 else Logical("$or", tuple(parts))
    return Logical(node.op, tuple(parts))


def contradicts(conds: tuple[Cond, ...]) -> bool:
    """Whether bounds on a field that has one value at the most exclude each other."""
    low = high = None
    kinds = set()
    for c in conds:
        if c.op in COMPARISONS or (c.op == "$eq" and bracket(c.arg)):
            kinds.add(bracket(c.arg))
            strict = c.op in ("$gt", "$lt")
            if c.op in ("$gt", "$gte", "$eq") and (low is None or compare(c.arg, low[0]) > 0 or (compare(c.arg, low[0]) == 0 and strict)):
                low = (c.arg, strict)
            if c.op in ("$lt", "$lte", "$eq") and (high is None or compare(c.arg, high[0]) < 0 or (compare(c.arg, high[0]) == 0 and strict)):
                high = (c.arg, strict)
    if len(kinds) > 1:
        return True
    return bool(low and high and (compare(low[0], high[0]) > 0 or (compare(low[0], high[0]) == 0 and (low[1] or high[1]))))
