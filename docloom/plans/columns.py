"""Filter tree + schema -> a Column. Null counts as false; every negation first turns it into false.

Type brackets are resolved at compile time: an operand of another bracket than the column's type can't
match, so nothing is ever coerced. Conditions on plain columns stay plain comparisons, which reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import NotSupported
from docloom.plans.filters import COMPARISONS, Cond, Field, Logical, Regex, contradicts, simplify
from docloom.values import ObjectId, bracket, is_number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def bracket_of(kind: T.DataType) -> str | None:
    for types, name in ((NUMERIC, "number"), ((T.StringType,), "string"), ((T.BooleanType,), "bool"), (DATES, "date")):
        if isinstance(kind, types):
            return name
    return None


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(parts: list[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return F.lit(False) if out is None else out


def all_of(parts: list[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


class FilterCompiler:
    """null_means: whether a null in a column stands for a null value ('null') or an absent field ('missing')."""

    def __init__(self, schema: T.StructType, null_means: str = "null"):
        self.schema, self.null_means = schema, null_means

    def compile(self, node) -> Column:
        return self._node(simplify(node), lambda name: F.col(f"`{name}`"), self.schema)

    def _node(self, node, field: Callable[[str], Column], schema: T.StructType) -> Column:
        if isinstance(node, Logical):
            if node.op == "$nor":
                return all_of([self._negated(p, field, schema) for p in node.parts])
            parts = [self._node(p, field, schema) for p in node.parts]
            return all_of(parts) if node.op == "$and" else any_of(parts)
        if self._single(node.path, schema) and contradicts(node.conds):
            return F.lit(False)
        return all_of([self._cond(node.path, c, field, schema) for c in node.conds])

    def _negated(self, node, field: Callable[[str], Column], schema: T.StructType) -> Column:
        """The condition doesn't hold. On plain columns that is a comparison again, which can be pushed down."""
        if isinstance(node, Field):
            return any_of([self._negated_cond(node.path, c, field, schema) for c in node.conds])
        return ~known(self._node(node, field, schema))

    def _negated_cond(self, path: tuple[str, ...], c: Cond, field, schema: T.StructType) -> Column:
        inner, plain = self._cond(path, c, field, schema), self._plain(path, field, schema)
        if plain is not None and c.arg is not None and (c.op in COMPARISONS or c.op == "$eq"):
            return ~inner | plain.isNull()
        return ~known(inner)

    def _single(self, path: tuple[str, ...], schema: T.DataType) -> bool:
        for name in path:
            if not isinstance(schema, T.StructType) or name not in schema.names:
                return True
            schema = schema[name].dataType
        return not isinstance(schema, T.ArrayType)

    def _walk(self, path: tuple[str, ...], field, schema: T.StructType, leaf: Callable[[Column | None, T.DataType | None, bool], Column]) -> Column:
        """Whether the leaf test holds for any branch of the path. leaf(column, type, whole); column None: missing."""
        name, rest = path[0], path[1:]
        if name not in schema.names:
            return leaf(None, None, False)
        return self._into(rest, field(name), schema[name].dataType, leaf)

    def _into(self, path: tuple[str, ...], col: Column, kind: T.DataType, leaf, whole: bool = False) -> Column:
        if not path:
            return leaf(col, kind, whole)
        if isinstance(kind, T.StructType):
            inner = self._walk(path, col.getField, kind, leaf)
            absent = leaf(None, None, False)
            return F.when(col.isNull(), absent).otherwise(inner)
        if not isinstance(kind, T.ArrayType):
            return leaf(None, None, False)
        parts = []
        if path[0].isdigit() and str(int(path[0])) == path[0]:
            at = F.get(col, F.lit(int(path[0])))
            parts.append((F.size(col) > int(path[0])) & self._into(path[1:], at, kind.elementType, leaf, whole=not path[1:]))
        element = kind.elementType
        if isinstance(element, T.StructType) and not (parts and path[0] not in element.names):
            parts.append(F.exists(col, lambda e: e.isNotNull() & known(self._walk(path, e.getField, element, leaf))))
        return F.when(col.isNull(), leaf(None, None, False)).otherwise(any_of([known(p) for p in parts]))

    def _cond(self, path: tuple[str, ...], c: Cond, field, schema: T.StructType) -> Column:
        op, arg = c.op, c.arg
        if op == "$never":
            return F.lit(False)
        if op in ("$ne", "$nin"):
            plain = self._plain(path, field, schema)
            positive = Cond("$eq" if op == "$ne" else "$in", arg)
            if plain is not None and arg is not None and not (op == "$nin" and None in arg):
                inner = self._cond(path, positive, field, schema)
                return ~inner | plain.isNull()
            return ~known(self._cond(path, positive, field, schema))
        if op == "$not":
            return any_of([self._negated_cond(path, x, field, schema) for x in arg])
        if op == "$all":
            return all_of([self._cond(path, x, field, schema) for x in arg]) if arg else F.lit(False)
        if op == "$exists":
            found = self._walk(path, field, schema, self._present)
            return found if arg else ~known(found)
        return self._walk(path, field, schema, lambda col, kind, whole: self._leaf(c, col, kind, whole))

    def _plain(self, path, field, schema) -> Column | None:
        """The column at the end of a path without arrays, if it isn't one."""
        if len(path) != 1 or path[0] not in schema.names or isinstance(schema[path[0]].dataType, (T.ArrayType, T.StructType)):
            return None
        return field(path[0])

    def _present(self, col: Column | None, kind, whole) -> Column:
        if col is None:
            return F.lit(False)
        return col.isNotNull() if self.null_means == "missing" else F.lit(True)

    def _leaf(self, c: Cond, col: Column | None, kind: T.DataType | None, whole: bool) -> Column:
        op, arg = c.op, c.arg
        if col is None:
            missing_is_null = (op == "$eq" and arg is None) or (op == "$in" and any(v is None for v in arg))
            return F.lit(True) if missing_is_null else F.lit(False)
        array = isinstance(kind, T.ArrayType)
        if op == "$size":
            return F.size(col) == arg if array else F.lit(False)
        if op == "$elemMatch":
            if not array:
                return F.lit(False)
            return F.exists(col, lambda e: all_of([known(self._element(x, e, kind.elementType)) for x in arg]))
        if op == "$elemMatchDoc":
            if not array or not isinstance(kind.elementType, T.StructType):
                return F.lit(False)
            return F.exists(col, lambda e: e.isNotNull() & known(self._node(arg, e.getField, kind.elementType)))
        own = self._value(c, col, kind)
        if array and not whole:
            return own | F.exists(col, lambda e: known(self._value(c, e, kind.elementType)))
        return own

    def _element(self, c: Cond, e: Column, kind: T.DataType) -> Column:
        """A condition of $elemMatch on an element itself; arrays in it aren't walked."""
        if c.op in ("$ne", "$nin"):
            return ~known(self._element(Cond("$eq" if c.op == "$ne" else "$in", c.arg), e, kind))
        if c.op == "$not":
            return ~known(all_of([self._element(x, e, kind) for x in c.arg]))
        if c.op == "$all":
            return all_of([self._element(x, e, kind) for x in c.arg]) if c.arg else F.lit(False)
        if c.op == "$exists":
            return F.lit(True) if c.arg else F.lit(False)
        return F.lit(False) if c.op == "$never" else self._leaf(c, e, kind, True)

    def _value(self, c: Cond, v: Column, kind: T.DataType) -> Column:
        if c.op == "$eq":
            return equals(v, kind, c.arg)
        if c.op == "$in":
            return self._in(v, kind, c.arg)
        if c.op == "$regex":
            return matches_regex(v, c.arg) if isinstance(kind, T.StringType) else F.lit(False)
        if c.op == "$type":
            return has_type(v, kind, c.arg, self.null_means)
        if c.op in COMPARISONS:
            return in_range(v, kind, c.op, c.arg)
        raise NotSupported(c.op)

    def _in(self, v: Column, kind: T.DataType, members: tuple) -> Column:
        own = bracket_of(kind)
        simple = [m for m in members if own in ("number", "string") and bracket(m) == own and m == m]
        parts = [v.isin(*simple)] if simple else []
        for m in members:
            if isinstance(m, Regex):
                parts.append(self._value(Cond("$regex", m), v, kind))
            elif not any(m is s for s in simple):
                parts.append(equals(v, kind, m))
        return any_of(parts)


def equals(v: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return v.isNull()
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        return all_of([F.size(v) == len(value), *(known(equals(F.get(v, F.lit(i)), kind.elementType, x)) for i, x in enumerate(value))])
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict) or list(value) != kind.names:
            return F.lit(False)
        return all_of([v.isNotNull(), *(known(equals(v.getField(n), kind[n].dataType, x)) for n, x in value.items())])
    if isinstance(kind, T.BinaryType):
        data = value.binary if isinstance(value, ObjectId) else value
        return v == F.lit(data) if isinstance(data, bytes) else F.lit(False)
    if isinstance(kind, T.StringType) and isinstance(value, ObjectId):
        return v == str(value)  # identifiers are kept as hexadecimal text in typed tables
    if bracket_of(kind) is None or bracket(value) != bracket_of(kind):
        return F.lit(False)
    if is_number(value) and value != value:
        return F.isnan(v) if isinstance(kind, FRACTIONAL) else F.lit(False)
    return v == F.lit(value)


def in_range(v: Column, kind: T.DataType, op: str, bound: Any) -> Column:
    if isinstance(bound, ObjectId):
        bound, own = (bound.binary, "objectId") if isinstance(kind, T.BinaryType) else (str(bound), "objectId" if isinstance(kind, T.StringType) else None)
        if own is None:
            return F.lit(False)
    elif bracket_of(kind) is None or bracket(bound) != bracket_of(kind):
        return F.lit(False)
    if is_number(bound) and math.isnan(bound):
        return F.isnan(v) if op in ("$gte", "$lte") and isinstance(kind, FRACTIONAL) else F.lit(False)
    compared = {"$gt": v > bound, "$gte": v >= bound, "$lt": v < bound, "$lte": v <= bound}[op]
    return compared & ~F.isnan(v) if isinstance(kind, FRACTIONAL) and op in ("$gt", "$gte") else compared  # NaN is the greatest number for Spark


def has_type(v: Column, kind: T.DataType, codes: frozenset[int], null_means: str) -> Column:
    parts = []
    if 10 in codes and null_means == "null":
        parts.append(v.isNull())
    if isinstance(kind, NUMERIC):
        whole = (v == F.floor(v)) & (v >= -(2**31)) & (v < 2**31)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            whole = v.isNotNull()
        if 16 in codes:
            parts.append(whole)
        rest = 18 if isinstance(kind, T.LongType) else 1
        if rest in codes:
            parts.append(v.isNotNull() & ~known(whole))
        return any_of(parts)
    fixed = {T.StringType: 2, T.StructType: 3, T.ArrayType: 4, T.BinaryType: 5, T.BooleanType: 8}
    code = next((c for t, c in fixed.items() if isinstance(kind, t)), 9 if isinstance(kind, DATES) else None)
    if code in codes:
        parts.append(v.isNotNull())
    return any_of(parts)


def matches_regex(v: Column, regex: Regex) -> Column:
    prefix = re.fullmatch(r"\^([A-Za-z0-9 _,:;@#%&=<>~'\"!/-]+)", regex.source)
    if prefix and not regex.flags:
        return v.startswith(prefix[1])
    return v.rlike(java_pattern(regex))


def java_pattern(regex: Regex) -> str:
    r"""A JavaScript-style pattern for Java: $ without m is the very end, i folds Unicode, . and \s have the same members."""
    out, escaped, inside = [], False, False
    space = r"\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    for c in regex.source:
        if escaped:
            escaped = False
            out[-1] = {"s": space if inside else f"[{space}]", "S": f"[^{space}]" if not inside else r"\S", "Z": r"\z"}.get(c, "\\" + c)
        elif c == "\\":
            escaped = True
            out.append(c)
        elif inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "$":
            out.append("$" if "m" in regex.flags else r"\z")
        elif c == ".":
            out.append("." if "s" in regex.flags else r"[^\n\r\x{2028}\x{2029}]")
        else:
            out.append(c)
    flags = "".join(regex.flags) + ("u" if "i" in regex.flags else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


__all__ = ["Field", "FilterCompiler", "bracket_of", "equals", "java_pattern", "known"]
