"""Client, catalog, writes, indexes and cursors over a temporary directory."""

import pytest

from docloom import BulkWriteError, Client, NotSupported, QueryError


@pytest.fixture()
def db(spark, tmp_path):
    return Client(spark, str(tmp_path / "store")).db("shop")


def test_documents_life(db):
    users = db.collection("users")
    assert users.find_one({}) is None and users.count_documents() == 0
    assert users.insert_many([{"_id": 1, "n": 1}, {"_id": "x", "n": [2, 3]}, {"n": None}])["inserted_count"] == 3
    assert users.count_documents() == 3 and users.count_documents({"n": {"$gt": 1}}) == 1 and users.count_documents({}, skip=1, limit=1) == 1
    assert users.find_one({"n": 3})["_id"] == "x"
    assert [d["_id"] for d in users.find().limit(2)] == [1, "x"]
    done = users.update_many({"n": {"$exists": True}}, {"$set": {"seen": True}})
    assert (done["matched_count"], done["modified_count"]) == (3, 3)
    assert users.update_one({"_id": 1}, {"$set": {"seen": True}})["modified_count"] == 0
    assert users.update_one({"_id": 9}, {"$inc": {"n": 5}}, upsert=True)["upserted_id"] == 9
    assert users.find_one({"_id": 9}) == {"_id": 9, "n": 5}
    assert users.delete_one({"_id": 9})["deleted_count"] == 1
    assert users.delete_many({"n": None})["deleted_count"] == 1
    assert users.delete_many({})["deleted_count"] == 2 and users.count_documents() == 0


def test_update_errors(db):
    c = db.collection("c")
    c.insert_one({"_id": 1, "s": "text"})
    for update, code in (({"$inc": {"s": 1}}, 14), ({"$set": {"_id": 5}}, 66)):
        with pytest.raises(QueryError) as e:
            c.update_many({}, update)
        assert e.value.code == code
    assert c.find_one() == {"_id": 1, "s": "text"}


def test_duplicates(db):
    c = db.collection("c")
    c.insert_one({"_id": 1})
    with pytest.raises(QueryError) as e:
        c.insert_one({"_id": 1.0})
    assert e.value.code == 11000
    with pytest.raises(BulkWriteError) as e:
        c.insert_many([{"_id": 2}, {"_id": 1}, {"_id": 3}])
    assert e.value.inserted_count == 1
    with pytest.raises(BulkWriteError) as e:
        c.insert_many([{"_id": 2}, {"_id": 3}, {"_id": 3}, {"_id": 4}], ordered=False)
    assert e.value.inserted_count == 2 and [w["index"] for w in e.value.write_errors] == [0, 2]
    assert sorted(d["_id"] for d in c.find()) == [1, 2, 3, 4]


def test_unique_index(db):
    c = db.collection("c")
    assert c.create_index({"login": 1}, unique=True) == "login_1"
    c.insert_many([{"_id": 1, "login": "a"}, {"_id": 2}, {"_id": 3, "login": ["b", "b", "c"]}])
    for doc in ({"login": "a"}, {"login": None}, {"x": 1}, {"login": ["d", "c"]}):
        with pytest.raises(QueryError) as e:
            c.insert_one(doc)
        assert e.value.code == 11000
    with pytest.raises(QueryError) as e:
        c.create_index({"login": -1})
    assert e.value.code == 85
    with pytest.raises(QueryError):
        c.update_one({"_id": 2}, {"$set": {"login": "a"}})
    assert [i["name"] for i in c.list_indexes()] == ["_id_", "login_1"]
    c.drop_index("login_1")
    c.insert_one({"login": "a"})
    for which, code in (("login_1", 27), ("_id_", 72)):
        with pytest.raises(QueryError) as e:
            c.drop_index(which)
        assert e.value.code == code


def test_catalog(db):
    db.collection("a").insert_one({"x": 1})
    db.collection("b").insert_one({"x": 1})
    assert [c["name"] for c in db.list_collections()] == ["a", "b"]
    assert db.list_collections({"name": "a"}, name_only=True) == [{"name": "a", "type": "collection"}]
    for args, code in ((("a", "a"), 20), (("z", "y"), 26), (("a", "b"), 48)):
        with pytest.raises(QueryError) as e:
            db.rename_collection(*args)
        assert e.value.code == code
    db.rename_collection("a", "b", drop_target=True)
    assert [c["name"] for c in db.list_collections()] == ["b"]
    assert db.collection("b").drop() and not db.collection("b").drop()
    with pytest.raises(QueryError):
        db.collection("b").list_indexes()
    assert db.drop_database()


def test_cursor(db):
    c = db.collection("c")
    c.insert_many([{"_id": i, "a": i % 3} for i in range(9)])
    cursor = c.find({}).sort([("a", -1), ("_id", 1)]).skip(1).limit(3)
    assert cursor.has_next() and [d["_id"] for d in cursor] == [5, 8, 1] and cursor.next() is None
    with pytest.raises(QueryError, match="already initialized"):
        cursor.limit(1)
    assert [d["_id"] for d in c.find(sort={"_id": -1}, limit=-2)] == [8, 7]
    assert c.aggregate([{"$match": {"a": 1}}, {"$count": "n"}]).to_list() == [{"n": 3}]
    assert c.aggregate([{"$group": {"_id": "$a", "n": {"$sum": 1}}}]).sort("_id").limit(1).to_list() == [{"_id": 0, "n": 3}]
    for bad in (lambda: c.find().sort({"a": 2}), lambda: c.find().skip(-1), lambda: c.find().skip(1.5), lambda: c.find().allow_disk_use(1)):
        with pytest.raises(QueryError):
            bad()


def test_typed(spark, db):
    df = spark.createDataFrame([(1, "a", 1.0, [1, 2]), (2, "b", None, []), (3, "a", 3.0, None)], "id int, s string, v double, t array<int>")
    c = db.collection("typed")
    c.create_from_frame(df, ["id"])
    assert c.count_documents({"t": 2}) == 1 and [d["id"] for d in c.find({"s": "a"}).sort("id", -1)] == [3, 1]
    c.update_many({"s": "a"}, {"$inc": {"v": 1}, "$push": {"t": {"$each": [0, 9], "$sort": -1, "$slice": 3}}, "$set": {"w": "new"}})
    assert c.find({}).sort("id").to_list() == [{"id": 1, "s": "a", "v": 2.0, "t": [9, 2, 1], "w": "new"}, {"id": 2, "s": "b", "v": None, "t": [], "w": None}, {"id": 3, "s": "a", "v": 4.0, "t": [9, 0], "w": "new"}]
    c.update_one({"s": "a"}, {"$pull": {"t": {"$gte": 9}}, "$max": {"v": 10}, "$rename": {"w": "z"}})
    assert c.find_one({"id": 1}) == {"id": 1, "s": "a", "v": 10.0, "t": [2, 1], "w": None, "z": "new"}
    assert c.delete_one({"s": "a"})["deleted_count"] == 1 and c.delete_many({"v": None})["deleted_count"] == 1
    with pytest.raises(QueryError):
        c.insert_frame(c.frame())
    with pytest.raises(NotSupported):
        c.insert_many([{"_id": 1}])
    with pytest.raises(QueryError):
        c.update_many({}, {"$set": {"id": 5}})


def test_typed_counts_and_ids(spark, db):
    """Only rows that change are modified, an id may be set to itself, and rows without ids are updated and deleted one at a time."""
    c = db.collection("t")
    c.create_from_frame(spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), ["id"])
    done = c.update_many({}, {"$set": {"s": "a"}})
    assert (done["matched_count"], done["modified_count"]) == (2, 1)
    before = c.frame().inputFiles()
    done = c.update_many({"id": 1}, {"$set": {"id": 1, "s": "a"}})
    assert (done["matched_count"], done["modified_count"]) == (1, 0) and c.frame().inputFiles() == before
    assert c.update_one({"id": 7}, {"$set": {"s": "new"}}, upsert=True)["upserted_id"] == 7 and c.update_one({"id": 7}, {"$set": {"s": "x"}}, upsert=True)["upserted_count"] == 0
    with pytest.raises(NotSupported):
        c.insert_one({"id": 8, "other": 1})
    with pytest.raises(QueryError) as e:
        c.insert_one({"id": 7, "s": "y"})
    assert e.value.code == 11000 and c.count_documents() == 3
    bare = db.collection("bare")
    bare.create_from_frame(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "k string, n int").repartition(2), [])
    assert bare.update_one({"k": "x"}, {"$inc": {"n": 5}})["modified_count"] == 1 and bare.count_documents({"n": 6}) == 1
    assert bare.delete_one({"k": "x"})["deleted_count"] == 1 and bare.count_documents() == 2
    assert bare.delete_one({"k": "z"})["deleted_count"] == 0


def test_null_parents(spark, db):
    rows = [(1, None), (2, (3, None))]
    for means in ("missing", "null"):
        c = db.collection(means)
        c.create_from_frame(spark.createDataFrame(rows, "id int, d struct<a:int,e:struct<x:int>>"), ["id"], null_means=means)
        if means == "null":
            with pytest.raises(QueryError) as e:
                c.update_many({}, {"$set": {"d.a": 5}})
            assert e.value.code == 28
            continue
        assert c.update_many({}, {"$set": {"d.a": 5, "d.e.y": "new"}})["modified_count"] == 2
        assert [d["d"] for d in c.find().sort("id")] == [{"a": 5, "e": {"x": None, "y": "new"}}] * 2
        assert c.update_many({}, {"$unset": {"d.e.y": ""}})["modified_count"] == 2


def test_any_column_name(spark, db):
    c = db.collection("names")
    c.create_from_frame(spark.createDataFrame([(1, 2, [3, 4], 5)], "k int, __x int, __item array<int>, __hit int"), ["k"])
    assert c.find_one() == {"k": 1, "__x": 2, "__item": [3, 4], "__hit": 5}
    assert c.aggregate([{"$unwind": "$__item"}, {"$sort": {"__item": -1}}, {"$project": {"__x": 1, "__item": 1}}]).to_list() == [{"__x": 2, "__item": 4}, {"__x": 2, "__item": 3}]
    assert c.update_many({"__hit": 5}, {"$set": {"__x": 9}})["modified_count"] == 1 and c.find_one({"__x": 9})["__hit"] == 5


def test_patterns_alike(spark, db):
    """Both profiles take a pattern as JavaScript does."""
    texts = ["é", "w_1", "٣", "7", "a b", "a\u00a0b", "Ünï", "x\ny", "ab-cd", "]"]
    typed, mixed = db.collection("typed"), db.collection("mixed")
    typed.create_from_frame(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"])
    mixed.insert_many([{"_id": i, "t": t} for i, t in enumerate(texts)])
    expected = {r"^\w+$": {1, 3}, r"\d": {1, 3}, r"\bb": {4, 5}, r"a\sb": {4, 5}, r"^\W$": {0, 2, 9}, r"[\d_]": {1, 3}, r"[^\w\s]": {0, 2, 6, 8, 9}, r"^\p{L}+$": {0, 6}, r"^(?<first>a)(?<rest>.*)$": {4, 5, 8}, "^x$": set(), r"[\W]": {0, 2, 4, 5, 6, 7, 8, 9}, r"^\D+$": {0, 2, 4, 5, 6, 7, 8, 9}}
    for pattern, found in expected.items():
        assert {d["i"] for d in typed.find({"t": {"$regex": pattern}})} == found, pattern
        assert {d["_id"] for d in mixed.find({"t": {"$regex": pattern}})} == found, pattern
    for c, key in ((typed, "i"), (mixed, "_id")):
        assert {d[key] for d in c.find({"t": {"$regex": "^Y$", "$options": "im"}})} == {7} and {d[key] for d in c.find({"t": {"$regex": "x.y", "$options": "s"}})} == {7} and {d[key] for d in c.find({"t": {"$regex": "üN"}})} == set()


def test_skip_plans(spark):
    """A skip without a limit is dealt by ranges: no plan brings all rows to one task."""
    from docloom.operators.pipeline import natural, parse_pipeline, run_pipeline

    df = spark.range(1000).selectExpr("id AS _id", "id % 7 AS a").repartition(5)
    for stages, expected in (([{"$skip": 990}], [*range(990, 1000)]), ([{"$sort": {"a": -1}}, {"$skip": 995}], [966, 973, 980, 987, 994]), ([{"$skip": 1000}], []), ([{"$skip": 5000}], []), ([{"$skip": 998}, {"$match": {"a": {"$gte": 0}}}], [998, 999])):
        out = run_pipeline(natural(df, ["_id"]), parse_pipeline(stages))
        assert out.columns == ["_id", "a"] and [r["_id"] for r in out.collect()] == expected if "$sort" in stages[0] else sorted(r["_id"] for r in out.collect()) == expected
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert run_pipeline(natural(df.filter("false"), ["_id"]), parse_pipeline([{"$skip": 3}])).count() == 0


def test_store(spark, tmp_path):
    """Manifests appear whole and once; what the newest version doesn't name can be deleted."""
    from docloom.sources.store import Conflict, Store

    store = Store(spark, str(tmp_path / "s"))
    store.commit("d", 0, {"collections": {}})
    with pytest.raises(Conflict):
        store.commit("d", 0, {"collections": {"late": {}}})
    assert store.read("d") == (1, {"collections": {}}) and [p.name for p in (tmp_path / "s/d/_catalog").iterdir() if not p.name.startswith(".")] == ["v0000000001.json"]
    c = Client(spark, str(tmp_path / "s")).db("d").collection("c")
    c.insert_many([{"_id": i} for i in range(3)])
    c.delete_many({"_id": 1})
    assert len(c.database.vacuum(0)) >= 2 and c.count_documents({"_id": {"$gte": 0}}) == 2 and c.database.vacuum(0) == []


def test_sets_of_groups(spark):
    """$addToSet beside other accumulators: values in the order of their first rows, null as its collection takes it, as the exact profile gives them."""
    from docloom.operators.pipeline import natural, parse_pipeline, run_pipeline

    rows = [(i, None if i % 6 == 5 else i % 3, None if i % 4 == 1 else (i * 7) % 5, f"v{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "_id long, k int, v int, w string").repartition(4)
    stages = parse_pipeline([{"$sort": {"_id": -1}}, {"$group": {"_id": "$k", "vs": {"$addToSet": "$v"}, "n": {"$sum": 1}, "ws": {"$addToSet": "$w"}}}])
    only = parse_pipeline([{"$group": {"_id": "$k", "vs": {"$addToSet": "$v"}}}])
    for means in ("null", "missing"):
        expected, first = {}, {}
        for _, k, v, w in reversed(rows):
            e = expected.setdefault(k, ([], 0, []))
            expected[k] = (e[0] + [v] * (v not in e[0] and (v is not None or means == "null")), e[1] + 1, e[2] + [w] * (w not in e[2]))
        for _, k, v, _ in rows:
            f = first.setdefault(k, [])
            if v not in f and (v is not None or means == "null"):
                f.append(v)
        out = run_pipeline(natural(df, ["_id"], means), stages)
        assert out.columns == ["_id", "vs", "n", "ws"] and {r["_id"]: (r["vs"], r["n"], r["ws"]) for r in out.collect()} == expected
        assert {r["_id"]: r["vs"] for r in run_pipeline(natural(df, ["_id"], means), only).collect()} == first
    assert run_pipeline(natural(df.filter("false"), ["_id"]), only).count() == 0
