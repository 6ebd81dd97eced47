"""Aggregation pipelines over typed DataFrames: eight stages, each a step of the logical plan.

Rows have no order of their own, so the order that $first, $last, $push, $addToSet, $skip and $limit see is
carried as sort keys: the collection's id at first, then the keys of $sort. Keys that a later stage would
lose are kept in hidden columns, only if a later stage asks for them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import NotSupported, QueryError
from docloom.operators.accumulators import NAMES, ORDERED, accumulator
from docloom.operators.ordering import ascending, ordering, scalar_keys, sort_keys
from docloom.plans.columns import FilterCompiler
from docloom.plans.expressions import HIDDEN, expression, visible
from docloom.plans.filters import parse_filter
from docloom.sources.scratch import checkpoint

STAGES = ("$match", "$group", "$sort", "$skip", "$limit", "$project", "$unwind", "$count")


def parse_pipeline(pipeline: Any) -> list[tuple[str, Any]]:
    """Validate every stage before anything is planned."""
    if not isinstance(pipeline, (list, tuple)):
        raise QueryError(14, "'pipeline' option must be specified as an array")
    out = []
    for stage in pipeline:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise QueryError(40323, "A pipeline stage specification object must contain exactly one field.")
        ((op, arg),) = stage.items()
        if not op.startswith("$"):
            raise QueryError(40324, f"Unrecognized pipeline stage name: '{op}'")
        if op not in STAGES:
            raise NotSupported(f"the stage {op}")
        out.append((op, CHECKS[op](arg)))
    return out


def check_match(arg: Any):
    if not isinstance(arg, dict):
        raise QueryError(15959, "the match filter must be an expression in an object")
    return parse_filter(arg)


def check_group(arg: Any) -> dict:
    if not isinstance(arg, dict):
        raise QueryError(15947, "a group's fields must be specified in an object")
    if "_id" not in arg:
        raise QueryError(15955, "a group specification must include an _id")
    for name, spec in arg.items():
        if name == "_id":
            continue
        if "." in name:
            raise QueryError(40235, f"The field name '{name}' cannot contain '.'")
        if name.startswith("$"):
            raise QueryError(40236, f"The field name '{name}' cannot be an operator name")
        if not isinstance(spec, dict):
            raise QueryError(40234, f"The field '{name}' must be an accumulator object")
        if len(spec) != 1:
            raise QueryError(40238, f"The field '{name}' must specify one accumulator")
        op = next(iter(spec))
        if op not in NAMES:
            raise NotSupported(f"the accumulator {op}")
        if op == "$count" and spec[op] != {}:
            raise QueryError(5362100, "$count takes no arguments, i.e. $count:{}")
    return arg


def check_sort(arg: Any) -> dict[str, bool]:
    if not isinstance(arg, dict):
        raise QueryError(15973, "the $sort key specification must be an object")
    if not arg:
        raise QueryError(15976, "$sort stage must have at least one sort key")
    for v in arg.values():
        if isinstance(v, bool) or v not in (1, -1):
            raise QueryError(15975, "$sort key ordering must be 1 (for ascending) or -1 (for descending)")
    return {k: v == -1 for k, v in arg.items()}


def check_count_of_rows(code: int, least: int, low: int):
    def check(arg: Any) -> int:
        if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg != int(arg) or arg < 0:
            raise QueryError(code, f"invalid argument: expected a non-negative whole number, got {arg!r}")
        if arg < least:
            raise QueryError(low, "the limit must be positive")
        return int(arg)

    return check


def check_project(arg: Any) -> tuple[str, dict]:
    """('include' or 'exclude', nested tree of True, False or ('expr', value))."""
    if not isinstance(arg, dict):
        raise QueryError(15969, "$project specification must be an object")
    if not arg:
        raise QueryError(51272, "projection specification must have at least one field")
    tree: dict = {}
    modes = set()

    def put(node: dict, path: list[str], value: Any, full: str) -> None:
        if not all(path):
            raise QueryError(40353 if full else 40352, "FieldPath must not have empty parts.")
        if any(p.startswith("$") for p in path):
            raise QueryError(16410, "FieldPath field names may not start with '$'.")
        *parents, last = path
        for p in parents:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise QueryError(31250, f"Path collision at {full}")
        if isinstance(value, dict) and value and not next(iter(value)).startswith("$"):
            child = node.setdefault(last, {})
            if not isinstance(child, dict):
                raise QueryError(31250, f"Path collision at {full}")
            for k, v in value.items():
                put(child, k.split("."), v, f"{full}.{k}")
            return
        if isinstance(value, dict) and not value:
            raise QueryError(51270, "An empty sub-projection is not a valid value.")
        if last in node:
            raise QueryError(31250, f"Path collision at {full}")
        if isinstance(value, (bool, int, float)):
            node[last] = bool(value)
            if full != "_id":
                modes.add(bool(value))
        else:
            node[last] = ("expr", value)
            modes.add("expr")

    for key, value in arg.items():
        put(tree, key.split("."), value, key)
    if False in modes and (True in modes or "expr" in modes):
        raise QueryError(31254 if "expr" not in modes else 31253, "cannot mix exclusion and inclusion in one projection")
    if not modes:
        modes.add(tree.get("_id", True) is not False)
    return ("exclude" if False in modes else "include"), tree


def check_unwind(arg: Any) -> dict:
    spec = {"path": arg} if isinstance(arg, str) else arg
    if not isinstance(spec, dict):
        raise QueryError(15981, "expected either a string or an object as specification for $unwind stage")
    for k, v in spec.items():
        if k == "preserveNullAndEmptyArrays" and not isinstance(v, bool):
            raise QueryError(28809, "expected a boolean for the preserveNullAndEmptyArrays option")
        if k == "includeArrayIndex" and (not isinstance(v, str) or not v):
            raise QueryError(28810, "expected a non-empty string for the includeArrayIndex option")
        if k == "includeArrayIndex" and v.startswith("$"):
            raise QueryError(28822, "includeArrayIndex must not be prefixed with '$'")
        if k not in ("path", "preserveNullAndEmptyArrays", "includeArrayIndex"):
            raise QueryError(28811, f"unrecognized option to $unwind stage: {k}")
    path = spec.get("path")
    if path is None:
        raise QueryError(28812, "no path specified to $unwind stage")
    if not isinstance(path, str):
        raise QueryError(28808, "expected a string as the path for $unwind stage")
    if not path.startswith("$") or len(path) < 2:
        raise QueryError(28818, "path option to $unwind stage should be prefixed with a '$'")
    return {"path": path[1:].split("."), "keep": spec.get("preserveNullAndEmptyArrays", False), "index": spec.get("includeArrayIndex")}


def check_count(arg: Any) -> str:
    if not isinstance(arg, str) or not arg:
        raise QueryError(40156, "the count field must be a non-empty string")
    if arg.startswith("$"):
        raise QueryError(40158, "the count field cannot be a $-prefixed path")
    if "." in arg:
        raise QueryError(40160, "the count field cannot contain '.'")
    return arg


CHECKS = {
    "$match": check_match, "$group": check_group, "$sort": check_sort, "$skip": check_count_of_rows(5107200, 0, 5107200), "$limit": check_count_of_rows(5107201, 1, 15958),
    "$project": check_project, "$unwind": check_unwind, "$count": check_count,
}


@dataclass(frozen=True)
class Flow:
    """A DataFrame and the order of its rows. pending: the output is to be sorted. arranged: the DataFrame itself is sorted now, so a limit joins the sort before it."""

    df: DataFrame
    order: tuple[tuple[Column, T.DataType, bool], ...] = ()
    null_means: str = "null"
    pending: bool = False
    arranged: bool = False

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*ordering(list(self.order))) if self.order and not self.arranged else self.df


def wants_order(stages: list[tuple[str, Any]]) -> bool:
    """Whether a later stage looks at the order that rows have before these stages."""
    for op, arg in stages:
        if op in ("$skip", "$limit") or (op == "$group" and any(next(iter(v)) in ORDERED for k, v in arg.items() if k != "_id")):
            return True
        if op in ("$group", "$count"):
            return False
    return False


def hide(flow: Flow) -> Flow:
    """Keep the sort keys in hidden columns, so a projection can't lose them."""
    names = [f"{HIDDEN}o{len(flow.df.columns)}_{i}" for i in range(len(flow.order))]
    df = flow.df.withColumns({n: k for n, (k, _, _) in zip(names, flow.order)})
    return replace(flow, df=df, order=tuple((F.col(f"`{n}`"), t, d) for n, (_, t, d) in zip(names, flow.order)))


def natural(df: DataFrame, ids: list[str], null_means: str = "null") -> Flow:
    """A collection in the order of its id columns; without any, in the order of its files."""
    keys = [k for i in ids for k in scalar_keys(F.col(f"`{i}`"), df.schema[i].dataType, False)]
    if not ids:
        df = df.withColumn(f"{HIDDEN}o0", F.monotonically_increasing_id())
        keys = [(F.col(f"`{HIDDEN}o0`"), T.LongType(), False)]
    return Flow(df, tuple(keys), null_means)


def run_pipeline(flow: Flow, stages: list[tuple[str, Any]], ordered_output: bool = True) -> DataFrame:
    """The rows of a validated pipeline. Sorted output is sorted by Spark; other output has no order unless a sort is pending."""
    for i, (op, arg) in enumerate(stages):
        rest = stages[i + 1 :]
        if op in ("$project", "$unwind") and (flow.pending or wants_order(rest)):
            flow = hide(flow)
        flow = step_skip(flow, arg, any(o == "$limit" for o, _ in rest[:1])) if op == "$skip" else STEPS[op](flow, arg)
    df = flow.sorted() if flow.pending and ordered_output else flow.df
    return df.select(*(f"`{f.name}`" for f in visible(df.schema)))


def step_match(flow: Flow, node) -> Flow:
    return replace(flow, df=flow.df.filter(FilterCompiler(visible(flow.df.schema), flow.null_means).compile(node)), arranged=False)


def step_sort(flow: Flow, spec: dict[str, bool]) -> Flow:
    keys = sort_keys(spec, flow.df.schema, id_whole=True)
    return replace(flow, order=(*keys, *flow.order), pending=True, arranged=False)


def step_skip(flow: Flow, n: int, limited: bool = True) -> Flow:
    """Before a limit, the offset joins it and the sort. Without one, all rows but n remain: they are dealt by ranges of the order and counted per range."""
    if not n:
        return flow
    if limited or not flow.order:
        return replace(flow, df=flow.sorted().offset(n), arranged=True)
    flow = hide(flow)
    keys, part, place = ordering(list(flow.order)), f"{HIDDEN}part", f"{HIDDEN}place"
    dealt = flow.df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place))
    dealt = checkpoint(dealt)  # the bounds of the ranges are sampled: fix them once
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy(part).collect()  # one row per range
    before, shifts = 0, []
    for r in counts:
        shifts.append((r[part], before - r["first"]))
        before += r["n"]
    shift = flow.df.sparkSession.createDataFrame(shifts, f"`{part}` int, `{HIDDEN}shift` long")
    rest = dealt.join(F.broadcast(shift), part).filter(F.col(f"`{place}`") + F.col(f"`{HIDDEN}shift`") >= n).drop(f"{HIDDEN}shift")
    return replace(flow, df=rest.drop(part, place), arranged=False)


def step_limit(flow: Flow, n: int) -> Flow:
    return replace(flow, df=flow.sorted().limit(n), arranged=True)


def step_count(flow: Flow, name: str) -> Flow:
    counted = flow.df.agg(F.count(F.lit(1)).alias(name))
    return Flow(counted.filter(F.col(f"`{name}`") > 0), (), flow.null_means)


def step_group(flow: Flow, spec: dict) -> Flow:
    schema = flow.df.schema
    key, kind = expression(spec["_id"], schema)
    order = None
    if any(next(iter(v)) in ORDERED for k, v in spec.items() if k != "_id"):
        parts = [c for k, t, d in flow.order for c in ascending(k, t, d)]
        if len(flow.order) == 1 and isinstance(flow.order[0][1], T.IntegralType) and not flow.order[0][2]:
            order = F.coalesce(flow.order[0][0].cast("long"), F.lit(-(2**63)))  # a fixed-width key keeps min_by in a hash aggregate
        else:
            order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(parts))) if parts else F.monotonically_increasing_id()
    constant = key is None or not uses_fields(spec["_id"])
    sets = {} if constant else {name: v["$addToSet"] for name, v in spec.items() if name != "_id" and "$addToSet" in v and distinct_argument(v["$addToSet"], schema)}
    if sets:
        return Flow(grouped_sets(flow, spec, key, order, sets), (), flow.null_means)
    aggregates = [accumulator(*next(iter(v.items())), schema, order, flow.null_means).alias(name) for name, v in spec.items() if name != "_id"]
    if constant:  # one group, and none for no rows
        n = f"{HIDDEN}rows"
        df = flow.df.groupBy().agg(F.count(F.lit(1)).alias(n), *aggregates).filter(F.col(f"`{n}`") > 0)
        df = df.select((F.lit(None) if key is None else key).alias("_id"), *(f"`{name}`" for name in spec if name != "_id"))
    else:
        grouped = flow.df.groupBy(key.alias("_id"))
        df = grouped.agg(*aggregates) if aggregates else flow.df.select(key.alias("_id")).distinct()
    return Flow(df, (), flow.null_means)


def distinct_argument(arg: Any, schema: T.StructType) -> Any:
    """The argument of $addToSet, if it is one value that a row can have."""
    arg = arg[0] if isinstance(arg, list) and len(arg) == 1 else arg
    return arg if not isinstance(arg, list) and expression(arg, schema)[0] is not None else None


def grouped_sets(flow: Flow, spec: dict, key: Column, order: Column, sets: dict[str, Any]) -> DataFrame:
    """Groups with sets of values: each value of a group is reduced to its first place before the values are collected, so a group's repeats never meet in one row."""
    schema, names = flow.df.schema, [n for n in spec if n != "_id"]
    group, value, place = (f"{HIDDEN}{x}" for x in ("group", "value", "place"))
    others = {n: v for n, v in spec.items() if n not in sets}
    df = step_group(flow, others).df if len(others) > 1 or flow.null_means == "missing" else None
    for name, arg in sets.items():
        x, _ = expression(distinct_argument(arg, schema), schema)
        rows = flow.df.select(key.alias(group), x.alias(value), order.alias(place))
        rows = rows.filter(F.col(f"`{value}`").isNotNull()) if flow.null_means == "missing" else rows
        firsts = rows.groupBy(group, value).agg(F.min(place).alias(place)).groupBy(group)
        listed = F.sort_array(F.collect_list(F.struct(F.col(f"`{place}`").alias("o"), F.col(f"`{value}`").alias("v"))))
        found = firsts.agg(F.transform(listed, lambda s: s["v"]).alias(name))
        if df is None:
            df = found.withColumnRenamed(group, "_id")
            continue
        df = df.join(found, df["_id"].eqNullSafe(found[group]), "left").drop(group)
        df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(found.schema[name].dataType)))
    return df.select("`_id`", *(f"`{n}`" for n in names))


def uses_fields(e: Any) -> bool:
    if isinstance(e, str):
        return e.startswith("$")
    if isinstance(e, dict):
        return "$literal" not in e and any(map(uses_fields, e.values()))
    return isinstance(e, (list, tuple)) and any(map(uses_fields, e))


def step_project(flow: Flow, arg: tuple[str, dict]) -> Flow:
    mode, tree = arg
    schema = flow.df.schema
    hidden = [F.col(f"`{n}`") for n in flow.df.columns if n.startswith(HIDDEN)]
    fields = visible(schema)
    if mode == "exclude":
        out = [c.alias(f.name) for f in fields if (c := excluded(F.col(f"`{f.name}`"), f.dataType, tree.get(f.name))) is not None]
    else:
        out = included(fields, lambda n: F.col(f"`{n}`"), {"_id": True} | tree if tree.get("_id") is not False else {k: v for k, v in tree.items() if k != "_id"}, schema)
    if not out:
        raise NotSupported("a projection without a field in typed rows")
    return replace(flow, df=flow.df.select(*out, *hidden))


def excluded(col: Column, kind: T.DataType, node: Any) -> Column | None:
    if node is None or node is True:
        return col
    if node is False:
        return None
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda e: excluded(e, kind.elementType, node))
    if not isinstance(kind, T.StructType):
        return col
    kept = [c.alias(f.name) for f in kind if (c := excluded(col.getField(f.name), f.dataType, node.get(f.name))) is not None]
    if not kept:
        raise NotSupported("a document without fields in typed rows")
    return F.when(col.isNotNull(), F.struct(*kept))


def included(fields: T.StructType, get, tree: dict, schema: T.StructType) -> list[Column]:
    """Kept fields in the order of the document, then the computed ones in the order of the specification."""
    out = []
    for f in fields:
        node = tree.get(f.name)
        if node is True:
            out.append(get(f.name).alias(f.name))
        elif isinstance(node, dict):
            inner = nested(get(f.name), f.dataType, node, schema)
            if inner is not None:
                out.append(inner.alias(f.name))
    for name, node in tree.items():
        if isinstance(node, tuple):
            col, _ = expression(node[1], schema)
            if col is not None:
                out.append(col.alias(name))
        elif isinstance(node, dict) and name not in fields.names and computed(node):
            out.append(F.struct(*included(T.StructType(), lambda n: None, node, schema)).alias(name))
    return out


def computed(node: dict) -> bool:
    return any(isinstance(v, tuple) or (isinstance(v, dict) and computed(v)) for v in node.values())


def nested(col: Column, kind: T.DataType, node: dict, schema: T.StructType) -> Column | None:
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.when(col.isNotNull(), F.array().cast("array<string>"))  # elements that aren't documents are dropped
        return F.transform(col, lambda e: nested(e, kind.elementType, node, schema))
    if not isinstance(kind, T.StructType):
        return F.struct(*included(T.StructType(), lambda n: None, node, schema)) if computed(node) else None
    kept = included(kind, col.getField, node, schema)
    return F.when(col.isNotNull(), F.struct(*kept)) if kept else None


def step_unwind(flow: Flow, spec: dict) -> Flow:
    path, keep, index = spec["path"], spec["keep"], spec["index"]
    df, schema = flow.df, visible(flow.df.schema)
    col, kind = None, schema
    for name in path:  # through documents only
        if not isinstance(kind, T.StructType) or name not in kind.names:
            col, kind = None, None
            break
        col, kind = (F.col(f"`{name}`") if col is None else col.getField(name)), kind[name].dataType
    if col is None:
        df = df if keep else df.filter(F.lit(False))
        return replace(flow, df=with_path(df, index, F.lit(None).cast("long")) if index else df)
    if not isinstance(kind, T.ArrayType):
        df = df if keep else df.filter(col.isNotNull())
        return replace(flow, df=with_path(df, index, F.lit(None).cast("long")) if index else df)
    pos, item = f"{HIDDEN}u{len(df.columns)}", f"{HIDDEN}item"
    exploded = (F.posexplode_outer if keep else F.posexplode)(col).alias(pos, item)
    df = df.select("*", exploded)
    parent = F.col(f"`{path[0]}`")
    df = df.withColumn(path[0], F.col(f"`{item}`") if len(path) == 1 else parent.withField(".".join(path[1:]), F.col(f"`{item}`"))).drop(item)
    if index:
        df = with_path(df, index, F.col(f"`{pos}`").cast("long"))
    order = (*flow.order, (F.col(f"`{pos}`"), T.IntegerType(), False)) if flow.order else ()
    return replace(flow, df=df, order=order, arranged=False)


def with_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    first, *rest = path.split(".")
    if not rest:
        return df.withColumn(first, value)
    if first in df.columns and isinstance(df.schema[first].dataType, T.StructType):
        return df.withColumn(first, F.col(f"`{first}`").withField(".".join(rest), value))
    for name in reversed(rest):
        value = F.struct(value.alias(name))
    return df.withColumn(first, value)


STEPS = {"$match": step_match, "$group": step_group, "$sort": step_sort, "$skip": step_skip, "$limit": step_limit, "$project": step_project, "$unwind": step_unwind, "$count": step_count}
