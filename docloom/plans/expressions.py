"""Pipeline expressions over typed rows -> (Column, type); a type of None means the value is absent."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import NotSupported, QueryError

ABSENT: tuple[None, None] = (None, None)


#: The beginning of the names of helper columns: a control character, so a field of a document can have any printable name.
HIDDEN = "\x01"


def visible(schema: T.StructType) -> T.StructType:
    """Without the hidden order columns."""
    return T.StructType([f for f in schema if not f.name.startswith(HIDDEN)])


def path_value(path: list[str], col: Column, kind: T.DataType) -> tuple[Column | None, T.DataType | None]:
    """The rest of a field path; an array on the way gives the array of its documents' values, and numbers don't index."""
    if not path:
        return col, kind
    if isinstance(kind, T.StructType):
        return path_value(path[1:], col.getField(path[0]), kind[path[0]].dataType) if path[0] in kind.names else ABSENT
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        while isinstance(element, T.ArrayType):  # only documents have fields
            return ABSENT
        if not isinstance(element, T.StructType):
            return F.when(col.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType())
        probe, inner = path_value(path, F.lit(None), element)
        if probe is None:
            return F.when(col.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType())
        return F.transform(F.filter(col, lambda e: e.isNotNull()), lambda e: path_value(path, e, element)[0]), T.ArrayType(inner)
    return ABSENT


def root(schema: T.StructType) -> tuple[Column, T.StructType]:
    fields = visible(schema)
    return F.struct(*(F.col(f"`{f.name}`") for f in fields)), fields


def check_path(path: str) -> list[str]:
    parts = path.split(".")
    if not all(parts):
        raise QueryError(15998, "FieldPath field names may not be empty strings.")
    return parts


def expression(e: Any, schema: T.StructType) -> tuple[Column | None, T.DataType | None]:
    if isinstance(e, str) and e.startswith("$$"):
        name, _, rest = e[2:].partition(".")
        if name not in ("ROOT", "CURRENT"):
            raise NotSupported(f"the variable $${name}")
        return path_value(check_path(rest) if rest else [], *root(schema))
    if isinstance(e, str) and e.startswith("$"):
        first, *rest = check_path(e[1:])
        if first not in visible(schema).names:
            return ABSENT
        return path_value(rest, F.col(f"`{first}`"), schema[first].dataType)
    if isinstance(e, dict):
        if len(e) == 1 and next(iter(e)) == "$literal":
            return literal(e["$literal"])
        fields = []
        for name, x in e.items():
            if name.startswith("$"):
                raise NotSupported(f"the expression {name}")
            if not name or "." in name:
                raise QueryError(16412, "FieldPath field names may not contain '.'.")
            col, kind = expression(x, schema)
            if col is not None:
                fields.append((name, col, kind))
        if not fields:
            raise NotSupported("an expression document without a field in typed rows")
        return F.struct(*(c.alias(n) for n, c, _ in fields)), T.StructType([T.StructField(n, k) for n, _, k in fields])
    if isinstance(e, (list, tuple)):
        items = [expression(x, schema) for x in e]
        return list_of(items)
    return literal(e)


def list_of(items: list[tuple]) -> tuple[Column, T.DataType]:
    kinds = [k for _, k in items if k is not None and not isinstance(k, T.NullType)]
    kind = kinds[0] if kinds else T.StringType()
    numeric = all(isinstance(k, (T.NumericType)) for k in kinds)
    if any(k != kind for k in kinds):
        if not numeric:
            raise NotSupported("an array of several types in typed rows")
        kind = T.DoubleType() if any(isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)) for k in kinds) else T.LongType()
    cells = [(F.lit(None) if c is None else c).cast(kind) for c, _ in items]
    return F.array(*cells).cast(T.ArrayType(kind)), T.ArrayType(kind)


def literal(v: Any) -> tuple[Column, T.DataType]:
    if v is None:
        return F.lit(None), T.NullType()
    if isinstance(v, dict):
        parts = {n: literal(x) for n, x in v.items()}
        return F.struct(*(c.alias(n) for n, (c, _) in parts.items())), T.StructType([T.StructField(n, k) for n, (_, k) in parts.items()])
    if isinstance(v, (list, tuple)):
        return list_of([literal(x) for x in v])
    kind = T._infer_type(v)
    if isinstance(kind, T.LongType) and -(2**31) <= v < 2**31:
        kind = T.IntegerType()
    if isinstance(kind, T.TimestampType) and v.tzinfo is None:
        kind = T.TimestampNTZType()
    return F.lit(v).cast(kind), kind
