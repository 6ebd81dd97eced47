"""The nine $group accumulators as aggregate columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import QueryError
from docloom.plans.columns import FRACTIONAL
from docloom.plans.expressions import expression

ORDERED = {"$first", "$last", "$push", "$addToSet"}
NAMES = {"$sum", "$avg", "$min", "$max", "$count"} | ORDERED


def accumulator(op: str, arg: Any, schema: T.StructType, order: Column | None, null_means: str) -> Column:
    if op == "$count":
        if arg != {}:
            raise QueryError(5362100, "$count takes no arguments, i.e. $count:{}")
        return F.count(F.lit(1)).cast("long")
    if isinstance(arg, list):
        if len(arg) != 1:
            raise QueryError(40237, f"The {op} accumulator is a unary operator")
        arg = arg[0]
    x, kind = expression(arg, schema)
    number = isinstance(kind, T.NumericType)
    if op == "$sum":
        if not number:
            return F.lit(0)
        if arg == 1 and not isinstance(arg, bool):
            return F.count(F.lit(1)).cast("long")
        return F.coalesce(F.sum(x), F.lit(0))
    if op == "$avg":
        return F.avg(x.cast("double")) if number else F.lit(None).cast("double")
    if op in ("$min", "$max"):
        if x is None:
            return F.lit(None)
        if not isinstance(kind, FRACTIONAL):
            return F.min(x) if op == "$min" else F.max(x)
        nan = F.lit(float("nan")).cast(kind)
        proper = F.when(~F.isnan(x), x)
        return F.coalesce(F.max(proper), F.max(x)) if op == "$max" else F.when(F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)), nan).otherwise(F.min(proper))
    if op in ("$first", "$last"):
        if x is None:
            return F.lit(None)
        return (F.min_by if op == "$first" else F.max_by)(x, order)
    if x is None:
        return F.array().cast("array<string>")
    kept = F.struct(order.alias("o"), x.alias("v"))
    listed = F.collect_list(F.when(x.isNotNull(), kept) if null_means == "missing" else kept)
    values = F.transform(F.sort_array(listed), lambda s: s["v"])
    return F.array_distinct(values) if op == "$addToSet" else values
