"""Filters: worked tables for the exact matcher, and columns against the matcher on random rows."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import types as T

from docloom import NotSupported, ObjectId, QueryError, Regex
from docloom.functions.matcher import matches
from docloom.plans.columns import FilterCompiler
from docloom.plans.filters import parse_filter

NAN = float("nan")
RANGE_DOCS = [{"v": 5}, {"v": "5"}, {"v": None}, {}, {"v": [1, 9]}, {"v": NAN}, {"v": True}, {"v": datetime(2020, 1, 1)}]


@pytest.mark.parametrize(
    ("filter_", "hits"),
    [
        ({"v": {"$gt": 4}}, [0, 4]),
        ({"v": {"$gt": 4, "$lt": 6}}, [0, 4]),
        ({"v": {"$gte": "4"}}, [1]),
        ({"v": {"$lte": None}}, [2, 3]),
        ({"v": {"$gt": None}}, []),
        ({"v": {"$gte": NAN}}, [5]),
        ({"v": NAN}, [5]),
        ({"v": {"$lt": True}}, []),
        ({"v": {"$lte": True}}, [6]),
        ({"v": {"$lt": datetime(2021, 1, 1)}}, [7]),
        ({"v": None}, [2, 3]),
        ({"v": {"$ne": None}}, [0, 1, 4, 5, 6, 7]),
        ({"v": {"$exists": False}}, [3]),
        ({"v": {"$not": {"$gt": 4}}}, [1, 2, 3, 5, 6, 7]),
        ({"v": {"$in": [9, "5", None]}}, [1, 2, 3, 4]),
        ({"v": {"$nin": [5, None]}}, [1, 4, 5, 6, 7]),
        ({"v": {"$type": "int"}}, [0, 4]),
        ({"v": {"$type": ["string", "null"]}}, [1, 2]),
        ({"v": {"$type": "array"}}, [4]),
        ({"v": {"$size": 2}}, [4]),
        ({"v": {"$all": [1, 9]}}, [4]),
        ({"v": {"$all": []}}, []),
        ({"v": [1, 9]}, [4]),
        ({"v": {"$elemMatch": {"$gt": 1, "$lt": 9}}}, []),
        ({"v": {"$elemMatch": {"$gte": 1, "$lt": 9}}}, [4]),
        ({"$nor": [{"v": 5}, {"v": None}]}, [1, 4, 5, 6, 7]),
    ],
)
def test_matcher_ranges(filter_, hits):
    assert [i for i, d in enumerate(RANGE_DOCS) if matches(d, filter_)] == hits


def test_matcher_paths():
    docs = [{"a": [{"b": 1}, {"b": 2}]}, {"a": {"b": [1, 2]}}, {"a": [[{"b": 1}]]}, {"a": []}, {"a": 5}, {}, {"a": {"0": {"b": 1}}}, {"a": [{"c": 1}]}]
    hits = lambda f: [i for i, d in enumerate(docs) if matches(d, f)]
    assert hits({"a.b": 1}) == [0, 1]
    assert hits({"a.0.b": 1}) == [0, 2, 6]
    assert hits({"a.b": None}) == [4, 5, 6, 7]
    assert hits({"a.b": {"$exists": True}}) == [0, 1]
    assert hits({"a": {"$elemMatch": {"b": {"$gt": 1}}}}) == [0]


def test_regex_forms():
    docs = [{"s": "abc"}, {"s": "ABC\nx"}, {"s": ["zz", "abd"]}, {"s": 7}, {}, {"s": "abc\n"}]
    hits = lambda f: [i for i, d in enumerate(docs) if matches(d, f)]
    assert hits({"s": re.compile("^ab")}) == [0, 2, 5]
    assert hits({"s": {"$regex": "c$"}}) == [0]
    assert hits({"s": {"$regex": "^abc$", "$options": "im"}}) == [0, 1, 5]
    assert hits({"s": {"$in": [Regex("^z"), 7]}}) == [2, 3]
    assert hits({"s": {"$not": Regex("b")}}) == [1, 3, 4]


@pytest.mark.parametrize(
    "filter_",
    [{"$and": []}, {"$or": 1}, {"$foo": 1}, {"a": {"$foo": 1}}, {"a": {"$in": 1}}, {"a": {"$size": -1}}, {"a": {"$size": 1.5}}, {"a": {"$type": "x"}}, {"a": {"$not": 1}}, {"a": {"$all": 1}}, {"a": {"$elemMatch": 1}}, {"a": {"$options": "i"}}, {"a": {"$regex": "("}}, 5],
)
def test_malformed(filter_):
    with pytest.raises(QueryError):
        parse_filter(filter_)


@pytest.mark.parametrize("filter_", [{"a": {"$mod": [2, 0]}}, {"$expr": {}}, {"$where": "1"}, {"$text": {}}, {"a": {"$gt": {}}}, {"a": {"$regex": "a", "$options": "x"}}])
def test_unsupported(filter_):
    with pytest.raises(NotSupported):
        parse_filter(filter_)




def random_rows(rng, n):
    maybe = lambda v: None if rng.random() < 0.15 else v
    number = lambda: rng.choice([0.0, -0.0, 1.0, 2.5, -3.0, NAN, float("inf")])
    for i in range(n):
        yield {
            "id": i, "a": maybe(rng.randint(-2, 3)), "d": maybe(number()), "s": maybe(rng.choice(["", "a", "ab", "b", "Я"])), "b": maybe(rng.random() < 0.5),
            "t": maybe([maybe(number()) for _ in range(rng.randint(0, 3))]), "o": maybe({"x": maybe(rng.randint(0, 2)), "y": maybe([rng.randint(0, 2) for _ in range(rng.randint(0, 2))])}),
            "l": maybe([maybe({"k": maybe(rng.randint(0, 2)), "v": maybe(rng.choice("ab"))}) for _ in range(rng.randint(0, 3))]), "w": maybe(datetime(2020, 1, rng.randint(1, 5))),
        }


def random_condition(rng):
    value = lambda: rng.choice([0, 1, 2, 2.5, -3, NAN, "a", "b", True, None, datetime(2020, 1, 3)])
    bound = lambda: rng.choice([0, 1, 2.5, NAN, "a", "ab", True, datetime(2020, 1, 3), None])
    kind = rng.randint(0, 11)
    if kind == 0:
        return value()
    if kind <= 3:
        return {rng.choice(["$gt", "$gte", "$lt", "$lte"]): bound(), rng.choice(["$gt", "$lt", "$ne"]): rng.choice([0, 2, "b"])}
    if kind == 4:
        return {rng.choice(["$in", "$nin"]): [value() for _ in range(rng.randint(0, 3))]}
    if kind == 5:
        return {"$not": {rng.choice(["$gt", "$eq", "$lte"]): rng.choice([0, 1, "a"])}}
    if kind == 6:
        return {"$size": rng.randint(0, 3)}
    if kind == 7:
        return {"$all": [rng.choice([0, 1, 2, "a"]) for _ in range(2)]}
    if kind == 8:
        return {"$elemMatch": {"$gte": rng.choice([0, 1, "a"]), "$lt": rng.choice([2, 3, "b"])}}
    if kind == 9:
        return {"$elemMatch": {"k": rng.choice([0, 1, None]), "v": {"$ne": "a"}}}
    if kind == 10:
        return {"$type": rng.choice(["int", "double", "number", "string", "bool", "array", "object", "null", "date"])}
    return {"$regex": rng.choice(["^a", "b$", "я"]), "$options": rng.choice(["", "i"])}


def random_filter(rng, depth=2):
    if depth and rng.random() < 0.3:
        return {rng.choice(["$and", "$or", "$nor"]): [random_filter(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    path = rng.choice(["a", "d", "s", "b", "t", "o.x", "o.y", "l.k", "l.v", "l", "w", "t.0", "l.1.k", "o.y.0", "nothing", "o.nothing", "a.b"])
    return {path: random_condition(rng)}


def test_columns_agree_with_matcher(spark):
    rng = random.Random(11)
    schema = T._parse_datatype_string("id int, a int, d double, s string, b boolean, t array<double>, o struct<x:int,y:array<int>>, l array<struct<k:int,v:string>>, w timestamp_ntz")
    rows = list(random_rows(rng, 300))
    df = spark.createDataFrame(rows, schema).cache()
    from pyspark.sql import functions as F

    for _ in range(12):  # many filters in one job
        filters = [random_filter(rng) for _ in range(25)]
        compiled = [F.coalesce(FilterCompiler(schema).compile(parse_filter(f)), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters)]
        got = df.select("id", *compiled).collect()
        for i, f in enumerate(filters):
            expected = [r["id"] for r in rows if matches(r, f)]
            assert sorted(r["id"] for r in got if r[f"f{i}"]) == expected, f


def test_object_id():
    a, b = ObjectId(), ObjectId()
    assert a != b and ObjectId(str(a)) == a and len(a.binary) == 12
    assert matches({"_id": a}, {"_id": a}) and not matches({"_id": str(a)}, {"_id": a})
