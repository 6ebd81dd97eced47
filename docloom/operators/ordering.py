"""Sort keys: columns that Spark orders as the total order of values does, and ascending forms for min_by/max_by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import QueryError
from docloom.plans.columns import FRACTIONAL
from docloom.plans.expressions import path_value, visible


def direction(v) -> bool:
    """Whether a sort direction is descending."""
    if v in (1, "1", "asc", "ascending") and v is not True:
        return False
    if v in (-1, "-1", "desc", "descending"):
        return True
    raise QueryError(2, f"Invalid sort direction: {v!r}")


def sort_keys(spec: dict[str, bool], schema: T.StructType, id_whole: bool = False) -> list[tuple[Column, T.DataType, bool]]:
    """(key, type, descending) per sort path, several for values that need a rank before them. Absent paths give nothing: all rows tie."""
    fields = visible(schema)
    arrays, out = set(), []
    for path, descending in spec.items():
        first, *rest = path.split(".")
        if first not in fields.names:
            continue
        col, kind = path_value(rest, F.col(f"`{first}`"), fields[first].dataType)
        if col is None:
            continue
        if isinstance(kind, T.ArrayType) and not (id_whole and path == "_id" and len(spec) == 1):
            arrays.add(first)
            if len(arrays) > 1:
                raise QueryError(2, "cannot sort with keys that are parallel arrays")
            out += array_keys(col, kind.elementType, descending)
        else:
            out += scalar_keys(col, kind, descending)
    return out


def scalar_keys(col: Column, kind: T.DataType, descending: bool) -> list[tuple[Column, T.DataType, bool]]:
    if isinstance(kind, FRACTIONAL):  # NaN below all numbers, above null
        return [(F.when(col.isNotNull(), F.when(F.isnan(col), 0).otherwise(1)), T.IntegerType(), descending), (col, kind, descending)]
    return [(col, kind, descending)]


def array_keys(col: Column, element: T.DataType, descending: bool) -> list[tuple[Column, T.DataType, bool]]:
    """The least or greatest element; an empty array below null."""
    number = isinstance(element, FRACTIONAL)
    proper = F.filter(col, lambda e: e.isNotNull() & ~F.isnan(e)) if number else F.filter(col, lambda e: e.isNotNull())
    nulls = F.exists(col, lambda e: e.isNull()) if not descending else F.forall(col, lambda e: e.isNull())
    rank = F.when(col.isNull(), 1).when(F.size(col) == 0, 0).when(nulls, 1)
    if number:
        odd = F.exists(col, lambda e: F.isnan(e)) if not descending else F.size(proper) == 0
        rank = rank.when(odd, 2)
    rank = rank.otherwise(3)
    best = F.array_max(proper) if descending else F.array_min(proper)
    return [(rank, T.IntegerType(), descending), (F.when(rank == 3, best), element, descending)]


def ordering(keys: list[tuple[Column, T.DataType, bool]]) -> list[Column]:
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k, _, descending in keys]


def ascending(key: Column, kind: T.DataType, descending: bool) -> list[Column]:
    """Columns that compare upwards as the key does in its direction, for min_by and max_by, where nulls need a rank of their own."""
    if isinstance(kind, T.NullType):
        return [F.lit(0)]
    if not descending:
        return [F.when(key.isNull(), 0).otherwise(1), key]
    rank = F.when(key.isNull(), 1).otherwise(0)
    if isinstance(kind, T.BooleanType):
        return [rank, ~key]
    if isinstance(kind, T.NumericType):
        return [rank, -key.cast("decimal(38,0)") if isinstance(kind, T.IntegralType) else -key]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [rank, -F.unix_micros(key.cast("timestamp"))]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return [rank, F.concat(F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))]
    raise QueryError(2, f"cannot order {kind.simpleString()} values downwards")
