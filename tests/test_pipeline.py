"""Pipelines: worked tables in both profiles, and the typed one against the dynamic one."""

import pytest

from docloom import NotSupported, QueryError
from docloom.operators.dynamic import Documents, from_documents, run_documents
from docloom.operators.pipeline import natural, parse_pipeline, run_pipeline
from docloom.values import from_json, order_key
from docloom.streaming.stateless import stream

DOCS = [
    {"_id": 1, "k": "a", "v": 1.5, "s": "x"}, {"_id": 2, "k": "a", "v": "text"}, {"_id": 3, "k": "b", "v": None}, {"_id": 4, "v": 2}, {"_id": 5, "k": None, "v": [1, 2]},
    {"_id": 6, "k": "b", "o": {"p": 7}}, {"_id": 7, "k": "a", "v": 3},
]


def dynamic(spark, docs, pipeline):
    return [from_json(r["doc"]) for r in run_documents(Documents(from_documents(spark, docs)), parse_pipeline(pipeline)).collect()]


def by_id(rows):
    return {order_key(r["_id"]): r for r in rows}


def test_accumulators_on_mixed_types(spark):
    spec = {"_id": "$k", "sum": {"$sum": "$v"}, "avg": {"$avg": "$v"}, "min": {"$min": "$v"}, "max": {"$max": "$v"}, "first": {"$first": "$v"}, "last": {"$last": "$v"}, "all": {"$push": "$v"}, "n": {"$count": {}}, "set": {"$addToSet": "$s"}}
    rows = by_id(dynamic(spark, DOCS, [{"$group": spec}]))
    assert rows[order_key("a")] == {"_id": "a", "sum": 4.5, "avg": 2.25, "min": 1.5, "max": "text", "first": 1.5, "last": 3, "all": [1.5, "text", 3], "n": 3, "set": ["x"]}
    assert rows[order_key("b")] == {"_id": "b", "sum": 0, "avg": None, "min": None, "max": None, "first": None, "last": None, "all": [None], "n": 2, "set": []}
    assert rows[order_key(None)] == {"_id": None, "sum": 2, "avg": 2.0, "min": 2, "max": [1, 2], "first": 2, "last": [1, 2], "all": [2, [1, 2]], "n": 2, "set": []}


def test_group_keys(spark):
    docs = [{"_id": i, "n": n} for i, n in enumerate([1, 1.0, -0.0, 0, float("nan"), float("nan"), "1"])] + [{"_id": 7}, {"_id": 8, "n": None}]
    rows = dynamic(spark, docs, [{"$group": {"_id": "$n", "c": {"$sum": 1}}}])
    assert sorted(r["c"] for r in rows) == [1, 2, 2, 2, 2]


PROJECT_DOC = {"_id": 1, "a": {"b": 1, "c": 2}, "d": [{"b": 1, "c": 2}, {"c": 3}, 3, [{"b": 4}]], "e": 5, "f": "x"}


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"e": 1}, {"_id": 1, "e": 5}),
        ({"f": 1, "e": 1, "_id": 0}, {"e": 5, "f": "x"}),
        ({"a.b": 1}, {"_id": 1, "a": {"b": 1}}),
        ({"d.b": 1}, {"_id": 1, "d": [{"b": 1}, {}, [{"b": 4}]]}),
        ({"d.b": 0, "a": 0}, {"_id": 1, "d": [{"c": 2}, {"c": 3}, 3, [{}]], "e": 5, "f": "x"}),
        ({"x": "$a.b", "y": "$nothing"}, {"_id": 1, "x": 1}),
        ({"x": ["$e", "$nothing"], "z": {"$literal": "$e"}}, {"_id": 1, "x": [5, None], "z": "$e"}),
        ({"x": "$d.b"}, {"_id": 1, "x": [1]}),
        ({"_id": 0}, {k: v for k, v in PROJECT_DOC.items() if k != "_id"}),
    ],
)
def test_project(spark, spec, expected):
    assert dynamic(spark, [PROJECT_DOC], [{"$project": spec}]) == [expected]


def test_unwind(spark):
    docs = [{"_id": 1, "t": [1, 2]}, {"_id": 2, "t": []}, {"_id": 3, "t": None}, {"_id": 4}, {"_id": 5, "t": 7}]
    assert sorted((d["_id"], d["t"]) for d in dynamic(spark, docs, [{"$unwind": "$t"}])) == [(1, 1), (1, 2), (5, 7)]
    kept = dynamic(spark, docs, [{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$sort": {"_id": 1, "i": 1}}])
    assert kept == [{"_id": 1, "t": 1, "i": 0}, {"_id": 1, "t": 2, "i": 1}, {"_id": 2, "i": None}, {"_id": 3, "t": None, "i": None}, {"_id": 4, "i": None}, {"_id": 5, "t": 7, "i": None}]


def test_sort_orders_types(spark):
    values = [[], None, float("nan"), -1, 2.5, "a", "b", {"x": 1}, b"z", False, True]
    docs = [{"_id": i, "v": v} for i, v in enumerate(values)]
    assert [d["_id"] for d in dynamic(spark, docs, [{"$sort": {"v": 1}}])] == list(range(len(values)))
    assert [d["_id"] for d in dynamic(spark, docs, [{"$sort": {"v": -1}}])] == list(reversed(range(len(values))))
    arrays = [{"_id": 1, "v": [5, -1]}, {"_id": 2, "v": 3}, {"_id": 3, "v": [0]}]
    assert [d["_id"] for d in dynamic(spark, arrays, [{"$sort": {"v": 1}}])] == [1, 3, 2]
    assert [d["_id"] for d in dynamic(spark, arrays, [{"$sort": {"v": -1}}])] == [1, 2, 3]


PIPELINES = [
    [{"$match": {"a": {"$gte": 1}}}, {"$sort": {"d": -1, "id": 1}}, {"$skip": 2}, {"$limit": 20}],
    [{"$group": {"_id": "$s", "n": {"$sum": 1}, "sum": {"$sum": "$a"}, "avg": {"$avg": "$a"}, "min": {"$min": "$d"}, "max": {"$max": "$d"}}}],
    [{"$sort": {"s": -1}}, {"$group": {"_id": "$b", "first": {"$first": "$id"}, "last": {"$last": "$id"}, "ids": {"$push": "$id"}}}],
    [{"$unwind": {"path": "$t", "includeArrayIndex": "i"}}, {"$group": {"_id": "$i", "n": {"$count": {}}, "low": {"$min": "$t"}}}],
    [{"$match": {"l": {"$elemMatch": {"k": 1}}}}, {"$project": {"k": "$l.k", "_id": 0, "id": 1}}],
    [{"$sort": {"t": 1}}, {"$limit": 50}, {"$project": {"id": 1, "_id": 0}}],
    [{"$sort": {"t": -1}}, {"$limit": 50}, {"$project": {"id": 1, "_id": 0}}],
    [{"$match": {"s": "zzz"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}],
    [{"$match": {"a": 1}}, {"$count": "n"}],
]


@pytest.mark.parametrize("pipeline", PIPELINES, ids=range(len(PIPELINES)))
def test_profiles_agree(spark, pipeline):
    import random

    from pyspark.sql import types as T

    from tests.test_filters import random_rows

    rows = list(random_rows(random.Random(3), 200))
    schema = T._parse_datatype_string("id int, a int, d double, s string, b boolean, t array<double>, o struct<x:int,y:array<int>>, l array<struct<k:int,v:string>>, w timestamp_ntz")
    typed = [r.asDict(recursive=True) for r in run_pipeline(natural(spark.createDataFrame(rows, schema), ["id"]), parse_pipeline(pipeline)).collect()]
    mixed = dynamic(spark, [{"_id": r["id"], **r} for r in rows], pipeline)
    for r in mixed:
        if "id" in r:
            r.pop("_id", None)
    if any("$sort" in s for s in pipeline) and not any("$group" in s for s in pipeline):
        assert list(map(order_key, typed)) == list(map(order_key, mixed))
    else:
        assert sorted(map(order_key, typed)) == sorted(map(order_key, mixed))


@pytest.mark.parametrize(
    ("stage", "code"),
    [
        ({"$limit": 0}, 15958), ({"$limit": -1}, 5107201), ({"$skip": 1.5}, 5107200), ({"$sort": {}}, 15976), ({"$sort": {"a": 2}}, 15975), ({"$sort": 1}, 15973), ({"$group": {}}, 15955), ({"$group": 1}, 15947),
        ({"$group": {"_id": 1, "a": 1}}, 40234), ({"$group": {"_id": 1, "a.b": {"$sum": 1}}}, 40235), ({"$group": {"_id": 1, "$a": {"$sum": 1}}}, 40236), ({"$group": {"_id": 1, "a": {"$count": 1}}}, 5362100),
        ({"$count": ""}, 40156), ({"$count": "$a"}, 40158), ({"$count": "a.b"}, 40160), ({"$unwind": 1}, 15981), ({"$unwind": "a"}, 28818), ({"$unwind": {}}, 28812), ({"$unwind": {"path": 1}}, 28808),
        ({"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": 1}}, 28809), ({"$unwind": {"path": "$a", "includeArrayIndex": ""}}, 28810), ({"$unwind": {"path": "$a", "x": 1}}, 28811), ({"$unwind": {"path": "$a", "includeArrayIndex": "$i"}}, 28822),
        ({"$project": 1}, 15969), ({"$project": {}}, 51272), ({"$project": {"a": 1, "b": 0}}, 31254), ({"$project": {"a": "$b", "b": 0}}, 31253), ({"$project": {"a": 1, "a.b": 1}}, 31250), ({"$project": {"a": {}}}, 51270), ({"$project": {"a.$b": 1}}, 16410),
        ({"a": 1}, 40324), ({}, 40323), ({"$match": {}, "$limit": 1}, 40323),
    ],
)
def test_stage_errors(stage, code):
    with pytest.raises(QueryError) as e:
        parse_pipeline([stage])
    assert e.value.code == code


@pytest.mark.parametrize("stage", [{"$lookup": {}}, {"$facet": {}}, {"$addFields": {}}, {"$unionWith": "x"}, {"$setWindowFields": {}}, {"$group": {"_id": 1, "a": {"$stdDevPop": "$x"}}}])
def test_unsupported_stages(stage):
    with pytest.raises(NotSupported):
        parse_pipeline([stage])


def test_parallel_arrays(spark):
    docs = [{"_id": 1, "a": [1], "b": [2]}]
    with pytest.raises(Exception, match="parallel arrays"):
        dynamic(spark, docs, [{"$sort": {"a": 1, "b": 1}}])


def test_topk_plan(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    out = run_pipeline(natural(df, ["x"]), parse_pipeline([{"$sort": {"x": -1}}, {"$skip": 5}, {"$limit": 10}]))
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["x"] for r in out.collect()] == list(range(94, 84, -1))


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = stream(source, [{"$match": {"id": {"$gte": 7}}}, {"$project": {"x": "$id"}}]).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["x"] for r in spark.table("streamed").collect()) == [7, 8, 9]
    with pytest.raises(NotSupported):
        stream(source, [{"$sort": {"id": 1}}])
