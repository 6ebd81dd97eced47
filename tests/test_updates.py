"""Update operators on documents."""

import pytest

from docloom import NotSupported, QueryError
from docloom.functions.updates import apply_update, parse_update, upserted


def run(doc, update):
    return apply_update({"_id": 1, **doc}, parse_update(update))


@pytest.mark.parametrize(
    ("doc", "update", "expected"),
    [
        ({"a": 1}, {"$set": {"b.c": 2}}, {"a": 1, "b": {"c": 2}}),
        ({"a": [1, 2]}, {"$set": {"a.3": 9}}, {"a": [1, 2, None, 9]}),
        ({"a": [1, 2]}, {"$unset": {"a.0": ""}}, {"a": [None, 2]}),
        ({"a": 1, "b": 2}, {"$unset": {"b": 1}}, {"a": 1}),
        ({"a": 1}, {"$inc": {"a": 2, "b": 3}}, {"a": 3, "b": 3}),
        ({"a": 5, "s": "x"}, {"$min": {"a": 3, "s": 9, "n": 1}}, {"a": 3, "s": 9, "n": 1}),
        ({"a": 5}, {"$max": {"a": "x"}}, {"a": "x"}),
        ({"a": {"x": 1}}, {"$rename": {"a.x": "b.y"}}, {"a": {}, "b": {"y": 1}}),
        ({"a": [3, 1]}, {"$push": {"a": {"$each": [2, 5], "$sort": 1, "$slice": 3}}}, {"a": [1, 2, 3]}),
        ({"a": [1, 2]}, {"$push": {"a": {"$each": [9], "$position": 1}}}, {"a": [1, 9, 2]}),
        ({"a": [1, 2]}, {"$push": {"a": {"$each": [9], "$position": -1}}}, {"a": [1, 9, 2]}),
        ({"a": [{"k": 2}, {"k": 1}]}, {"$push": {"a": {"$each": [], "$sort": {"k": 1}}}}, {"a": [{"k": 1}, {"k": 2}]}),
        ({"a": [1, 2, 3]}, {"$push": {"a": {"$each": [4], "$slice": -2}}}, {"a": [3, 4]}),
        ({}, {"$push": {"a": 1}}, {"a": [1]}),
        ({"a": [1, 2]}, {"$addToSet": {"a": {"$each": [2, 3, 3.0]}}}, {"a": [1, 2, 3]}),
        ({"a": [1, 2, 3, 2]}, {"$pull": {"a": 2}}, {"a": [1, 3]}),
        ({"a": [1, 2, 3]}, {"$pull": {"a": {"$gte": 2}}}, {"a": [1]}),
        ({"a": [{"k": 1, "v": 2}, {"k": 2}]}, {"$pull": {"a": {"k": 1}}}, {"a": [{"k": 2}]}),
        ({"a": 1}, {"$setOnInsert": {"b": 1}, "$set": {"a": 2}}, {"a": 2}),
    ],
)
def test_apply(doc, update, expected):
    assert run(doc, update) == {"_id": 1, **expected}


@pytest.mark.parametrize(
    ("update", "code"),
    [
        ({"$inc": {"s": 1}}, 14), ({"$inc": {"n": "x"}}, 14), ({"$set": {"a": 1, "a.b": 2}}, 40), ({"$set": {"_id": 2}}, 66), ({"$set": {"s.x": 1}}, 28), ({"$set": {"a..b": 1}}, 56),
        ({"$push": {"s": 1}}, 2), ({"a": 1}, 9), ({}, 9), ({"$rename": {"a": "a"}}, 2), ({"$push": {"l": {"$each": 1}}}, 2),
    ],
)
def test_errors(update, code):
    with pytest.raises(QueryError) as e:
        run({"s": "text", "n": 1, "l": []}, update)
    assert e.value.code == code


def test_unsupported():
    for update in ({"$mul": {"a": 2}}, {"$set": {"a.$": 1}}, {"$bit": {}}):
        with pytest.raises(NotSupported):
            parse_update(update)


def test_upsert():
    assert upserted({"a": 1, "b.c": 2, "d": {"$gt": 1}}, parse_update({"$set": {"e": 3}, "$setOnInsert": {"f": 4}}), "new") == {"_id": "new", "a": 1, "b": {"c": 2}, "e": 3, "f": 4}
    assert upserted({"_id": 7}, parse_update({"$set": {"e": 3}}), "new") == {"_id": 7, "e": 3}
