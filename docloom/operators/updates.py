"""Updates of typed rows: each change becomes one column expression, applied where the filter holds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import NotSupported, QueryError
from docloom.functions.updates import Change
from docloom.plans.columns import FRACTIONAL, FilterCompiler, equals, known
from docloom.plans.expressions import HIDDEN, literal


#: The columns that say whether a row matched and whether it changed.
HIT, CHANGED = f"{HIDDEN}hit", f"{HIDDEN}changed"


def updated_frame(df: DataFrame, condition: Column, changes: list[Change], ids: list[str], null_means: str = "missing") -> DataFrame:
    """The rows with the changes made where the condition holds, and HIT and CHANGED. A removed field is null; a new one is null in all other rows."""
    df = df.withColumn(HIT, known(condition))
    hit = F.col(f"`{HIT}`")
    renamed = {c.path: column_at(df, c.arg) for c in changes if c.op == "$renamed"}
    columns: dict[str, Column] = {}
    kinds = {f.name: f.dataType for f in df.schema if f.name != HIT}
    for c in changes:
        if c.op == "$setOnInsert":
            continue
        first, rest = c.path[0], c.path[1:]
        kind = kinds.get(first)
        old = columns.get(first, F.col(f"`{first}`") if kind is not None else None)
        value = renamed.get(c.path)
        new = change_at(old, kind, rest, c, value, null_means)
        if new is None:
            continue
        if first in ids:  # a change of an id to what it is is none
            message = f"Performing an update on the path '{first}' would modify the immutable field '_id'"
            new = F.when(new.eqNullSafe(old), old).otherwise(F.raise_error(F.lit(message)).cast(kind))
        kinds[first] = df.select(new.alias(first)).schema[first].dataType if rest or kind is None else kind
        columns[first] = F.when(hit, new).otherwise(widened(old, kind, kinds[first])) if old is not None else F.when(hit, new)
    differs = F.lit(False)
    for name, new in columns.items():
        own = widened(F.col(f"`{name}`"), df.schema[name].dataType, kinds[name]) if name in df.columns else None
        differs = differs | (~new.eqNullSafe(own) if own is not None else new.isNotNull())
    return df.withColumns({**columns, CHANGED: hit & differs})


def widened(col: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A document with the fields of another schema that it lacks as nulls."""
    if not isinstance(kind, T.StructType) or not isinstance(to, T.StructType) or kind == to:
        return col
    fields = (widened(col.getField(f.name), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType) for f in to)
    return F.when(col.isNotNull(), F.struct(*(c.alias(f.name) for c, f in zip(fields, to))))


def column_at(df: DataFrame, path: tuple[str, ...]) -> tuple[Column, T.DataType] | None:
    if path[0] not in df.columns:
        return None
    col, kind = F.col(f"`{path[0]}`"), df.schema[path[0]].dataType
    for name in path[1:]:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        col, kind = col.getField(name), kind[name].dataType
    return col, kind


def change_at(col: Column | None, kind: T.DataType | None, path: tuple[str, ...], c: Change, renamed: tuple | None, null_means: str) -> Column | None:
    if path and kind is not None:
        if not isinstance(kind, T.StructType):
            raise QueryError(28, f"Cannot create field '{path[0]}' in a value that is no document")
        inner = kind[path[0]].dataType if path[0] in kind.names else None
        new = change_at(col.getField(path[0]) if inner is not None else None, inner, path[1:], c, renamed, null_means)
        if new is None:
            return None
        if c.op in ("$unset", "$rename", "$pull"):  # nothing to remove below a null
            return F.when(col.isNotNull(), col.withField(path[0], new))
        empty = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind)) if kind.names else F.struct()
        absent = F.raise_error(F.lit(f"Cannot create field '{path[0]}' in element {{null}}")) if null_means == "null" else F.lit(None)
        made = change_at(empty.getField(path[0]) if inner is not None else None, inner, path[1:], c, renamed, null_means) if null_means != "null" else None
        return F.when(col.isNotNull(), col.withField(path[0], new)).otherwise(absent if made is None else empty.withField(path[0], made))
    if path:
        new = change_at(None, None, path[1:], c, renamed, null_means)
        return None if new is None else F.struct(new.alias(path[0]))
    return changed_column(col, kind, c, renamed)


def changed_column(col: Column | None, kind: T.DataType | None, c: Change, renamed: tuple | None) -> Column | None:
    op, arg = c.op, c.arg
    if op == "$renamed":
        return None if renamed is None else renamed[0]
    if op in ("$unset", "$rename"):
        return None if col is None else F.lit(None).cast(kind)
    if op == "$set":
        value, new_kind = literal(arg)
        if kind is not None and not fits(new_kind, kind):
            raise NotSupported(f"setting a {kind.simpleString()} field to a {new_kind.simpleString()} in typed rows")
        return value.cast(kind) if kind is not None else value
    if op == "$inc":
        if col is None:
            return F.lit(arg)
        if not isinstance(kind, T.NumericType):
            raise QueryError(14, f"Cannot apply $inc to a value of non-numeric type: {'.'.join(c.path)}")
        return F.coalesce(col, F.lit(0)) + F.lit(arg)
    if op in ("$min", "$max"):
        value, new_kind = literal(arg)
        if col is None:
            return value
        if not fits(new_kind, kind):
            raise NotSupported(f"comparing a {kind.simpleString()} field with a {new_kind.simpleString()} in typed rows")
        if isinstance(kind, FRACTIONAL):  # NaN is the least number here
            better = F.isnan(value) & ~F.isnan(col) | (value < col) if op == "$min" else F.isnan(col) | (~F.isnan(value) & (value > col))
            better = better & ~F.isnan(col) if op == "$min" else better & ~F.isnan(value)
        else:
            better = value < col if op == "$min" else value > col
        return F.when(col.isNull() | better, value.cast(kind)).otherwise(col)
    return changed_array(col, kind, c)


def fits(new: T.DataType, kind: T.DataType) -> bool:
    if isinstance(new, T.NullType) or new == kind:
        return True
    if isinstance(new, T.IntegralType):
        return isinstance(kind, T.NumericType)
    if isinstance(new, T.FractionalType):
        return isinstance(kind, T.FractionalType)
    return isinstance(new, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def changed_array(col: Column | None, kind: T.DataType | None, c: Change) -> Column | None:
    op, arg = c.op, c.arg
    if kind is not None and not isinstance(kind, T.ArrayType):
        raise QueryError(2, f"The field '{'.'.join(c.path)}' must be an array")
    if op == "$pull":
        if col is None:
            return None
        return F.filter(col, lambda e: ~known(pull_condition(arg, e, kind.elementType)))
    items = arg if op == "$addToSet" else arg["$each"]
    added, added_kind = literal(items)
    if col is None:
        col, kind = F.array().cast(added_kind), added_kind
    added = added.cast(kind)
    old = F.coalesce(col, F.array().cast(kind))
    if op == "$addToSet":  # repeats that were there before stay
        news = F.filter(F.array_distinct(added), lambda x: ~F.exists(old, lambda y: x.eqNullSafe(y)))
        return F.concat(old, news)
    at, size = arg.get("$position"), F.size(old)
    if at is None:
        out = F.concat(old, added)
    else:
        cut = F.greatest(F.lit(0), size + int(at)) if at < 0 else F.least(F.lit(int(at)), size)
        out = F.concat(F.slice(old, F.lit(1), cut), added, F.slice(old, cut + 1, size))
    sort = arg.get("$sort")
    if isinstance(sort, dict):
        out = sorted_by(out, kind.elementType, sort)
    elif sort is not None:
        out = F.sort_array(out, asc=sort == 1)
    if "$slice" in arg:
        n = int(arg["$slice"])
        out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
    return out


def sorted_by(items: Column, kind: T.DataType, spec: dict[str, int]) -> Column:
    """An array of documents in the order of some of their fields; equal ones keep their order."""

    def value(element: Column, path: str) -> Column:
        found, at = element, kind
        for name in path.split("."):
            if not isinstance(at, T.StructType) or name not in at.names:
                return F.lit(None)
            found, at = found.getField(name), at[name].dataType
        if isinstance(at, T.ArrayType):
            raise NotSupported("$sort by an array in $push on typed rows")
        return found

    def compared(a: Column, b: Column) -> Column:
        order = F.when(a["i"] < b["i"], -1).otherwise(1)
        for path, way in reversed(spec.items()):
            x, y = value(a["v"], path), value(b["v"], path)
            less, more = (x.isNull() & y.isNotNull()) | (x < y), (y.isNull() & x.isNotNull()) | (x > y)
            order = F.when(known(less), -way).when(known(more), way).otherwise(order)
        return order

    numbered = F.transform(items, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(numbered, compared), lambda s: s["v"])


def pull_condition(test: tuple, e: Column, kind: T.DataType) -> Column:
    how, arg = test
    if how == "value":
        return equals(e, kind, arg)
    compiler: Any = FilterCompiler(T.StructType())
    if how == "filter":
        return compiler._node(arg, e.getField, kind) & e.isNotNull() if isinstance(kind, T.StructType) else F.lit(False)
    out = F.lit(True)
    for c in arg:
        out = out & known(compiler._element(c, e, kind))
    return out
