"""Pipelines over documents of mixed types: rows (ord, doc), doc being canonical extended JSON.

Documents are judged and reshaped exactly, batch by batch in Arrow; sorting and grouping go through
order-preserving binary keys, so Spark sorts, shuffles, aggregates partially and spills as for any column.
No key is the beginning of another, so keys are simply concatenated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.documents import check_expression, evaluate, project, unwind
from docloom.functions.matcher import branches, matches
from docloom.values import MISSING, from_json, inverted, is_number, order_key, sort_value_key, to_json
from docloom.errors import QueryError

ROWS = pa.schema([("ord", pa.binary()), ("doc", pa.string())])
SCHEMA = "ord binary, doc string"


@dataclass(frozen=True)
class Documents:
    df: DataFrame  # ord, doc
    pending: bool = False
    arranged: bool = False

    def sorted(self) -> DataFrame:
        return self.df if self.arranged else self.df.orderBy("ord")


def from_documents(spark: SparkSession, docs: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([(bytearray(order_key(d.get("_id", MISSING))), to_json(d)) for d in docs], SCHEMA)


def each(df: DataFrame, f: Callable[[bytes, Any], Iterable[tuple[bytes, Any]]]) -> DataFrame:
    """Apply f(ord, document) -> rows of (ord, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, d in f(key, from_json(text)):
                    keys.append(k)
                    docs.append(to_json(d))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.string())], schema=ROWS)

    return df.mapInArrow(run, SCHEMA)


def filtered(df: DataFrame, node) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([matches(from_json(t), node) for t in batch.column(1).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, SCHEMA)


def document_sort_key(doc: dict, spec: dict[str, bool]) -> bytes:
    if list(spec) == ["_id"]:
        key = order_key(doc.get("_id", MISSING))
        return inverted(key) if spec["_id"] else key
    out, through = [], set()
    for path, descending in spec.items():
        parts = path.split(".")
        values = [v for v, _ in branches(doc, tuple(parts))]
        head: Any = doc
        for i, name in enumerate(parts):
            head = head.get(name) if isinstance(head, dict) else None
            if isinstance(head, list):
                through.add(tuple(parts[: i + 1]))
                break
        if len(through) > 1:
            raise QueryError(2, "cannot sort with keys that are parallel arrays")
        key = sort_value_key(values, descending)
        out.append(inverted(key) if descending else key)
    return b"".join(out)


def run_documents(flow: Documents, stages: list[tuple[str, Any]]) -> DataFrame:
    """The rows (ord, doc) of a validated pipeline, sorted where the pipeline sorts."""
    for op, arg in stages:
        flow = STEPS[op](flow, arg)
    return flow.sorted() if flow.pending else flow.df


def step_sort(flow: Documents, spec: dict[str, bool]) -> Documents:
    return replace(flow, df=each(flow.df, lambda key, d: [(document_sort_key(d, spec) + key, d)]), pending=True, arranged=False)


def step_count(flow: Documents, name: str) -> Documents:
    n = flow.df.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return Documents(n.select(F.lit(b"").alias("ord"), F.concat(F.lit("{" + to_json(name) + ":"), F.col("n").cast("string"), F.lit("}")).alias("doc")))


def step_unwind(flow: Documents, spec: dict) -> Documents:
    def f(key: bytes, d: dict) -> Iterable[tuple[bytes, dict]]:
        return ((key + i.to_bytes(8, "big"), x) for i, x in enumerate(unwind(d, spec["path"], spec["keep"], spec["index"])))

    return replace(flow, df=each(flow.df, f), arranged=False)


def step_group(flow: Documents, spec: dict) -> Documents:
    """Per row: the group's key and value, and per accumulator the argument as JSON, order key and number; then plain aggregates."""
    fields = [(name, *next(iter(s.items()))) for name, s in spec.items() if name != "_id"]
    fields = [(name, op, arg[0] if isinstance(arg, list) and len(arg) == 1 else arg) for name, op, arg in fields]
    for e in (spec["_id"], *(arg for _, _, arg in fields)):
        check_expression(e)
    kinds = [("ord", pa.binary()), ("key", pa.binary()), ("id", pa.string())]
    for i in range(len(fields)):
        kinds += [(f"j{i}", pa.string()), (f"k{i}", pa.binary()), (f"d{i}", pa.float64()), (f"n{i}", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = from_json(text)
                group = evaluate(spec["_id"], doc)
                row = [order, order_key(group), to_json(None if group is MISSING else group)]
                for _, op, arg in fields:
                    v = None if op == "$count" else evaluate(arg, doc)
                    exact = isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**53
                    row += [None if v is MISSING else to_json(v), order_key(v), float(v) if is_number(v) and not exact else None, v if exact else None]
                rows.append(row)
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], schema=schema)

    names = {pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.int64(): "long"}
    rows = flow.df.mapInArrow(run, ", ".join(f"{n} {names[t]}" for n, t in kinds))
    aggregates = [document_accumulator(op, i).alias(f"a{i}") for i, (_, op, _) in enumerate(fields)]
    groups = rows.groupBy("key").agg(F.min_by("id", "ord").alias("id"), *aggregates)
    parts: list[Column] = [F.lit('{"_id":'), F.col("id")]
    for i, (name, _, _) in enumerate(fields):
        parts += [F.lit("," + to_json(name) + ":"), F.coalesce(F.col(f"a{i}"), F.lit("null"))]
    return Documents(groups.select(F.col("key").alias("ord"), F.concat(*parts, F.lit("}")).alias("doc")))


def number_json(x: Column) -> Column:
    """A double as canonical JSON."""
    return F.when(F.isnan(x), '{"$num":"NaN"}').when(x == float("inf"), '{"$num":"Infinity"}').when(x == float("-inf"), '{"$num":"-Infinity"}').otherwise(x.cast("string"))


def document_accumulator(op: str, i: int) -> Column:
    json, key, double, whole = (F.col(f"{c}{i}") for c in "jkdn")
    present = json.isNotNull() & (json != "null")
    if op == "$count":
        return F.count(F.lit(1)).cast("string")
    if op == "$sum":
        total = F.coalesce(F.sum(double), F.lit(0.0)) + F.coalesce(F.sum(whole), F.lit(0))
        return F.when(F.count(double) == 0, F.coalesce(F.sum(whole), F.lit(0)).cast("string")).otherwise(number_json(total))
    if op == "$avg":
        return number_json(F.avg(F.coalesce(double, whole.cast("double"))))
    if op in ("$min", "$max"):
        return (F.min_by if op == "$min" else F.max_by)(F.when(present, json), F.when(present, key))
    if op in ("$first", "$last"):
        return (F.min_by if op == "$first" else F.max_by)(F.coalesce(json, F.lit("null")), F.col("ord"))
    listed = F.sort_array(F.collect_list(F.when(json.isNotNull(), F.struct(F.col("ord").alias("o"), json.alias("j"), key.alias("k")))))
    if op == "$push":
        return F.concat(F.lit("["), F.array_join(F.transform(listed, lambda s: s["j"]), ","), F.lit("]"))
    by_key = F.sort_array(F.transform(listed, lambda s: F.struct(s["k"].alias("k"), s["o"].alias("o"), s["j"].alias("j"))))
    firsts = F.get(F.transform(F.array(by_key), lambda rows: F.filter(rows, lambda s, at: (at == 0) | (F.get(rows, at - 1)["k"] != s["k"]))), F.lit(0))
    in_order = F.sort_array(F.transform(firsts, lambda s: F.struct(s["o"].alias("o"), s["j"].alias("j"))))
    return F.concat(F.lit("["), F.array_join(F.transform(in_order, lambda s: s["j"]), ","), F.lit("]"))


def step_project(flow: Documents, arg: tuple[str, dict]) -> Documents:
    mode, tree = arg
    return replace(flow, df=each(flow.df, lambda key, d: [(key, project(d, mode, tree))]))


STEPS = {
    "$match": lambda flow, node: replace(flow, df=filtered(flow.df, node), arranged=False),
    "$sort": step_sort,
    "$skip": lambda flow, n: replace(flow, df=flow.sorted().offset(n), arranged=True) if n else flow,
    "$limit": lambda flow, n: replace(flow, df=flow.sorted().limit(n), arranged=True),
    "$project": step_project,
    "$unwind": step_unwind,
    "$count": step_count,
    "$group": step_group,
}
