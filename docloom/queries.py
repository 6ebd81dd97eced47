"""Registered queries of the document engine and the SQL that gives the same rows."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import BulkWriteError, NotSupported, QueryError
from docloom.operators.dynamic import Documents, each, run_documents
from docloom.operators.pipeline import natural, parse_pipeline, run_pipeline
from docloom.plans.filters import Regex
from docloom.sources.client import Client, Collection
from docloom.sources.scratch import scratch_folder
from docloom.values import order_key

#: The columns that identify a row, in whose order a collection is read; lineitem has none.
IDS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate(spark: SparkSession, sf_dir: str, name: str, pipeline: list[dict]) -> DataFrame:
    return run_pipeline(natural(table(spark, sf_dir, name), IDS[name]), parse_pipeline(pipeline))


def add(key: str, name: str, pipeline: list[dict], sql: str | None = None, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    QUERIES[key] = lambda spark, sf_dir: after(aggregate(spark, sf_dir, name, pipeline))
    if sql:
        ORACLES[key] = sql


def rounded(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Sums of doubles depend on the order of addition: compare them to four digits."""
    return lambda df: df.withColumns({n: F.round(n, 4) for n in names})


def keep(*names: str) -> dict[str, Any]:
    return {"$project": dict.fromkeys(names, 1)}


FLAGSHIP = [
    {"$match": {"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"$gte": 1000}}},
    {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "avg": {"$avg": "$o_totalprice"}, "max": {"$max": "$o_totalprice"}}},
    {"$sort": {"total": -1, "_id": 1}},
]
add(
    "flagship", "orders", FLAGSHIP,
    "SELECT o_orderpriority AS _id, count(*)::BIGINT AS n, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS avg, max(o_totalprice) AS max FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 GROUP BY 1",
    rounded("total", "avg"),
)

# Filters: (collection, filter, kept columns, SQL condition)
DAY = datetime(1995, 3, 15)
FILTERS: dict[str, tuple[str, dict, tuple[str, ...], str]] = {
    "match_eq": ("orders", {"o_orderstatus": "F"}, ("o_orderkey", "o_orderstatus"), "o_orderstatus = 'F'"),
    "match_ne": ("customer", {"c_mktsegment": {"$ne": "BUILDING"}}, ("c_custkey", "c_mktsegment"), "c_mktsegment <> 'BUILDING'"),
    "match_nin": ("customer", {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, ("c_custkey",), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "match_range": ("lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}}, ("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity >= 10 AND l_quantity < 20"),
    "match_date_range": ("orders", {"o_orderdate": {"$gte": DAY, "$lt": datetime(1996, 1, 1)}}, ("o_orderkey", "o_orderdate"), "o_orderdate >= '1995-03-15' AND o_orderdate < '1996-01-01'"),
    "match_in": ("part", {"p_size": {"$in": [1, 7, 49, "x", None]}}, ("p_partkey", "p_size"), "p_size IN (1, 7, 49)"),
    "match_and": ("part", {"$and": [{"p_size": {"$gt": 10}}, {"p_retailprice": {"$lt": 1500}}]}, ("p_partkey",), "p_size > 10 AND p_retailprice < 1500"),
    "match_or": ("orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, ("o_orderkey",), "o_orderstatus = 'P' OR o_totalprice > 300000"),
    "match_nor": ("orders", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 100000}}]}, ("o_orderkey",), "NOT (o_orderstatus = 'F' OR o_totalprice < 100000)"),
    "match_not": ("part", {"p_size": {"$not": {"$gt": 10}}}, ("p_partkey", "p_size"), "NOT p_size > 10"),
    "match_cross_type": ("part", {"p_size": {"$gt": "5"}}, ("p_partkey",), "false"),
    "match_contradiction": ("part", {"p_size": {"$gt": 5, "$lt": 3}}, ("p_partkey",), "false"),
    "match_exists_true": ("nation", {"n_name": {"$exists": True}}, ("n_nationkey",), "true"),
    "match_exists_false": ("nation", {"nothing": {"$exists": False}}, ("n_nationkey",), "true"),
    "match_null_missing": ("nation", {"nothing": None}, ("n_nationkey",), "true"),
    "match_null_present": ("nation", {"n_name": None}, ("n_nationkey",), "n_name IS NULL"),
    "match_type_int": ("part", {"p_retailprice": {"$type": "int"}}, ("p_partkey", "p_retailprice"), "p_retailprice = floor(p_retailprice)"),
    "match_type_double": ("part", {"p_retailprice": {"$type": "double"}}, ("p_partkey",), "p_retailprice <> floor(p_retailprice)"),
    "match_type_number": ("part", {"p_retailprice": {"$type": "number"}}, ("p_partkey",), "true"),
    "match_type_string": ("part", {"p_name": {"$type": ["string", 10]}}, ("p_partkey",), "true"),
    "match_regex_prefix": ("part", {"p_name": Regex("^a")}, ("p_partkey", "p_name"), "regexp_matches(p_name, '^a')"),
    "match_regex_i": ("documents", {"text": {"$regex": "THE", "$options": "i"}}, ("doc_id",), "regexp_matches(text, 'THE', 'i')"),
    "match_regex_suffix": ("part", {"p_name": {"$regex": "e$"}}, ("p_partkey", "p_name"), "regexp_matches(p_name, 'e$')"),
    "match_regex_in": ("part", {"p_name": {"$in": [Regex("^b"), Regex("d$")]}}, ("p_partkey",), "regexp_matches(p_name, '^b') OR regexp_matches(p_name, 'd$')"),
    "match_regex_not": ("part", {"p_name": {"$not": Regex("a")}}, ("p_partkey",), "NOT regexp_matches(p_name, 'a')"),
    "match_regex_m": ("documents", {"text": {"$regex": "^[A-Z][a-z]+ [a-z]+$", "$options": "m"}}, ("doc_id",), "regexp_matches(text, '(?m)^[A-Z][a-z]+ [a-z]+$')"),
    "match_regex_s": ("documents", {"text": {"$regex": "\\.\\s.*e.$", "$options": "s"}}, ("doc_id",), "regexp_matches(text, '\\.\\s.*e.$', 's')"),
    "match_regex_property": ("documents", {"text": {"$regex": "\\p{Lu}\\p{L}+ \\d{2}\\b"}}, ("doc_id",), "regexp_matches(text, '\\p{Lu}\\p{L}+ [0-9]{2}\\b')"),
    "match_regex_named": ("part", {"p_name": {"$regex": "^(?<first>[a-z])[a-z]* (?<second>[a-m])"}}, ("p_partkey", "p_name"), "regexp_matches(p_name, '^(?P<first>[a-z])[a-z]* (?P<second>[a-m])')"),
    "match_size": ("embeddings", {"embedding": {"$size": 64}}, ("vec_id",), "len(embedding) = 64"),
    "match_all": ("embeddings", {"label": {"$all": [3]}}, ("vec_id", "label"), "label = 3"),
    "match_elem_value": ("embeddings", {"embedding": {"$elemMatch": {"$gt": 0.25, "$lt": 0.26}}}, ("vec_id",), "len(list_filter(embedding, lambda x: x > 0.25 AND x < 0.26)) > 0"),
    "match_array_bounds_differ": ("embeddings", {"embedding": {"$gt": 0.3, "$lt": -0.3}}, ("vec_id",), "len(list_filter(embedding, lambda x: x > 0.3)) > 0 AND len(list_filter(embedding, lambda x: x < -0.3)) > 0"),
    "match_position": ("embeddings", {"embedding.0": {"$gt": 0}}, ("vec_id",), "embedding[1] > 0"),
    "find_by_id": ("customer", {"c_custkey": 42}, ("c_custkey", "c_name"), "c_custkey = 42"),
    "find_id_in": ("customer", {"c_custkey": {"$in": [*range(1, 200, 17)]}}, ("c_custkey",), f"c_custkey IN ({', '.join(map(str, range(1, 200, 17)))})"),
}
for _key, (_table, _filter, _columns, _where) in FILTERS.items():
    add(_key, _table, [{"$match": _filter}, keep(*_columns)], f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_where}")

# Groups
add(
    "group_sum_avg_min_max", "lineitem",
    [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "price": {"$avg": "$l_extendedprice"}, "low": {"$min": "$l_discount"}, "high": {"$max": "$l_shipdate"}, "n": {"$count": {}}}}],
    "SELECT l_returnflag AS _id, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_shipdate) AS high, count(*)::BIGINT AS n FROM lineitem GROUP BY 1",
    rounded("qty", "price"),
)
add(
    "group_null_id", "orders", [{"$match": {"o_totalprice": {"$lt": 100000}}}, {"$group": {"_id": None, "avg": {"$avg": "$o_totalprice"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0}}],
    "SELECT round(avg(o_totalprice), 4) AS avg, count(*)::BIGINT AS n FROM orders WHERE o_totalprice < 100000", rounded("avg"),
)
add("group_no_rows", "orders", [{"$match": {"o_totalprice": {"$lt": 0}}}, {"$group": {"_id": 1, "n": {"$sum": 1}}}], "SELECT 1 AS _id, 1::BIGINT AS n WHERE false")
add("group_const_id", "orders", [{"$group": {"_id": "all", "n": {"$sum": 1}}}], "SELECT 'all' AS _id, count(*)::BIGINT AS n FROM orders")
add(
    "group_compound_id", "lineitem",
    [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "n": 1}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2",
)
add("group_missing_id", "orders", [{"$group": {"_id": "$nothing", "n": {"$sum": 1}}}, {"$project": {"_id": 0}}], "SELECT count(*)::BIGINT AS n FROM orders")
add(
    "group_first_last", "orders", [{"$group": {"_id": "$o_orderpriority", "first": {"$first": "$o_custkey"}, "last": {"$last": "$o_custkey"}}}],
    "SELECT o_orderpriority AS _id, arg_min(o_custkey, o_orderkey) AS first, arg_max(o_custkey, o_orderkey) AS last FROM orders GROUP BY 1",
)
add(
    "group_first_after_sort", "orders", [{"$sort": {"o_orderdate": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderstatus", "newest": {"$first": "$o_orderkey"}}}],
    "SELECT o_orderstatus AS _id, arg_min(o_orderkey, r) AS newest FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) GROUP BY 1",
)
add(
    "group_push", "part", [{"$match": {"p_size": {"$lte": 3}}}, {"$group": {"_id": "$p_size", "keys": {"$push": "$p_partkey"}}}],
    "SELECT p_size AS _id, list(p_partkey ORDER BY p_partkey) AS keys FROM part WHERE p_size <= 3 GROUP BY 1",
)
add(
    "group_add_to_set", "part", [{"$group": {"_id": "$p_brand", "sizes": {"$addToSet": "$p_size"}}}],
    "SELECT p_brand AS _id, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1", lambda df: df.withColumn("sizes", F.sort_array("sizes")),
)
add("group_sum_non_numeric", "orders", [{"$group": {"_id": "$o_orderpriority", "s": {"$sum": "$o_orderstatus"}}}], "SELECT o_orderpriority AS _id, 0 AS s FROM orders GROUP BY 1")
add("group_distinct", "orders", [{"$group": {"_id": "$o_custkey"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0}}], "SELECT count(DISTINCT o_custkey)::BIGINT AS n FROM orders")
add(
    "group_then_topk", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}],
    "SELECT o_custkey AS _id, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, _id LIMIT 10",
)

# Sort, skip, limit
add("sort_multi", "customer", [{"$sort": {"c_mktsegment": 1, "c_acctbal": -1, "c_custkey": 1}}, {"$limit": 50}, keep("c_custkey", "c_acctbal")], "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
add("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 100}, {"$limit": 10}, keep("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 100")
add("sort_limit_then_project", "part", [{"$sort": {"p_retailprice": 1, "p_partkey": 1}}, {"$limit": 5}, {"$project": {"name": "$p_name"}}], "SELECT p_name AS name FROM part ORDER BY p_retailprice, p_partkey LIMIT 5")
add("sort_by_array", "embeddings", [{"$sort": {"embedding": -1, "vec_id": 1}}, {"$limit": 7}, keep("vec_id")], "SELECT vec_id FROM embeddings ORDER BY list_max(embedding) DESC, vec_id LIMIT 7")
add("skip_limit_natural", "customer", [{"$skip": 30}, {"$limit": 7}, keep("c_custkey", "c_name")], "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 30")
add("skip_natural", "customer", [{"$skip": 130}, keep("c_custkey", "c_name")], "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 130)")
add(
    "skip_sorted", "orders", [{"$sort": {"o_orderdate": -1, "o_orderkey": 1}}, {"$skip": 700}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "newest": {"$first": "$o_orderkey"}}}],
    "SELECT o_orderstatus AS _id, count(*)::BIGINT AS n, arg_min(o_orderkey, r) AS newest FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r > 700 GROUP BY 1",
)


def skip_half_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row after half of the table, however large it is."""
    rows = table(spark, sf_dir, "documents")
    return run_pipeline(natural(rows, IDS["documents"]), parse_pipeline([{"$skip": rows.count() // 2}, {"$limit": 1}, keep("doc_id")]))


QUERIES["skip_half_table"] = skip_half_table
ORACLES["skip_half_table"] = "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM documents)"
add("skip_half", "documents", [{"$skip": 400}, {"$limit": 1}, keep("doc_id")], "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1 OFFSET 400")

# Projections
add("project_include", "nation", [keep("n_name", "n_regionkey")], "SELECT n_name, n_regionkey FROM nation")
add("project_exclude", "nation", [{"$project": {"n_regionkey": 0}}], "SELECT n_nationkey, n_name FROM nation")
add("project_rename", "part", [{"$project": {"name": "$p_name", "p_size": 1}}], "SELECT p_size, p_name AS name FROM part")
add("project_literal", "nation", [{"$project": {"n_name": 1, "one": {"$literal": 1}, "dollar": {"$literal": "$n_name"}}}], "SELECT n_name, 1 AS one, '$n_name' AS dollar FROM nation")
add("project_array", "nation", [{"$project": {"n_name": 1, "keys": ["$n_nationkey", "$n_regionkey"]}}], "SELECT n_name, [n_nationkey, n_regionkey] AS keys FROM nation")
add("project_nested", "nation", [{"$project": {"d": {"name": "$n_name", "keys": {"r": "$n_regionkey"}}}}, {"$project": {"name": "$d.name", "r": "$d.keys.r"}}], "SELECT n_name AS name, n_regionkey AS r FROM nation")
add("project_root", "region", [{"$project": {"all": "$$ROOT"}}, {"$project": {"name": "$all.r_name"}}], "SELECT r_name AS name FROM region")
add(
    "project_array_path", "orders", [{"$group": {"_id": "$o_custkey", "items": {"$push": {"k": "$o_orderkey", "p": "$o_totalprice"}}}}, {"$project": {"keys": "$items.k"}}],
    "SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1",
)

# Arrays
ITEMS = {"$group": {"_id": "$o_custkey", "items": {"$push": {"k": "$o_orderkey", "p": "$o_totalprice", "s": "$o_orderstatus"}}}}
add(
    "match_elem_doc", "orders", [ITEMS, {"$match": {"items": {"$elemMatch": {"p": {"$gt": 250000}, "s": "F"}}}}, keep("_id")],
    "SELECT DISTINCT o_custkey AS _id FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'",
)
add(
    "match_path_through_array", "orders", [ITEMS, {"$match": {"items.p": {"$gt": 300000}}}, keep("_id")],
    "SELECT DISTINCT o_custkey AS _id FROM orders WHERE o_totalprice > 300000",
)
add("match_all_elem", "orders", [ITEMS, {"$match": {"items.s": {"$all": ["F", "P"]}}}, keep("_id")], "SELECT o_custkey AS _id FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'P')")
add("unwind", "embeddings", [{"$match": {"vec_id": {"$lt": 20}}}, {"$unwind": "$embedding"}, keep("vec_id", "embedding")], "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings WHERE vec_id < 20")
add(
    "unwind_index", "embeddings", [{"$match": {"vec_id": {"$lt": 20}}}, {"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, keep("vec_id", "embedding", "i")],
    "SELECT vec_id, unnest(embedding) AS embedding, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings WHERE vec_id < 20",
)
add("unwind_all", "embeddings", [{"$unwind": "$embedding"}, keep("vec_id", "embedding")], "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
add(
    "unwind_index_all", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, keep("vec_id", "embedding", "i")],
    "SELECT vec_id, unnest(embedding) AS embedding, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings",
)
add("unwind_scalar", "nation", [{"$unwind": "$n_name"}, keep("n_name")], "SELECT n_name FROM nation")
add("unwind_preserve", "nation", [{"$unwind": {"path": "$nothing", "preserveNullAndEmptyArrays": True}}, keep("n_name")], "SELECT n_name FROM nation")
add(
    "unwind_group", "orders", [ITEMS, {"$unwind": "$items"}, {"$group": {"_id": "$items.s", "n": {"$sum": 1}, "max": {"$max": "$items.p"}}}],
    "SELECT o_orderstatus AS _id, count(*)::BIGINT AS n, max(o_totalprice) AS max FROM orders GROUP BY 1",
)
add(
    "unwind_group_sort_limit", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$group": {"_id": "$i", "low": {"$min": "$embedding"}, "n": {"$sum": 1}}}, {"$sort": {"low": 1, "_id": 1}}, {"$limit": 5}],
    "SELECT i AS _id, min(e) AS low, count(*)::BIGINT AS n FROM (SELECT unnest(embedding) AS e, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings) GROUP BY 1 ORDER BY low, _id LIMIT 5",
)

# Counts
add("count_stage", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F'")
add("count_zero", "orders", [{"$match": {"o_orderstatus": "?"}}, {"$count": "n"}], "SELECT 1::BIGINT AS n WHERE false")
add("empty_pipeline", "region", [], "SELECT * FROM region")

# Writes: a table is copied into a scratch collection, changed there, and read back.


def scratch(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    c = Client(spark, f"{scratch_folder(spark)}/scratch-{uuid.uuid4().hex}").db().collection(name)
    c.create_from_frame(table(spark, sf_dir, name), IDS[name])
    return c


def add_write(key: str, name: str, write: Callable[[Collection], Any], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = scratch(spark, sf_dir, name)
        result = write(c)
        return result if isinstance(result, DataFrame) else c.frame()

    QUERIES[key] = run
    ORACLES[key] = sql


def counts(c: Collection, result: dict, *names: str) -> DataFrame:
    return c.spark.createDataFrame([tuple(int(result[n]) for n in names)], ", ".join(f"{n} long" for n in names))


add_write(
    "update_set_inc_unset", "part", lambda c: c.update_many({"p_size": {"$lte": 10}}, {"$set": {"p_brand": "small"}, "$inc": {"p_retailprice": 0.5, "p_size": 100}, "$unset": {"p_type": ""}}),
    "SELECT p_partkey, p_name, CASE WHEN p_size <= 10 THEN 'small' ELSE p_brand END AS p_brand, CASE WHEN p_size > 10 THEN p_type END AS p_type, CASE WHEN p_size <= 10 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size <= 10 THEN p_retailprice + 0.5 ELSE p_retailprice END AS p_retailprice FROM part",
)
add_write("update_min_max", "customer", lambda c: c.update_many({}, {"$min": {"c_acctbal": 5000.0}, "$max": {"c_nationkey": 7}}), "SELECT c_custkey, c_name, greatest(c_nationkey, 7) AS c_nationkey, least(c_acctbal, 5000.0) AS c_acctbal, c_mktsegment FROM customer")
add_write("update_rename", "nation", lambda c: c.update_many({}, {"$rename": {"n_name": "title"}}), "SELECT n_nationkey, NULL::VARCHAR AS n_name, n_regionkey, n_name AS title FROM nation")
add_write("update_one", "nation", lambda c: c.update_one({"n_regionkey": 2}, {"$set": {"n_name": "first"}}), "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN 'first' ELSE n_name END AS n_name, n_regionkey FROM nation")
add_write(
    "update_push_slice", "embeddings", lambda c: c.update_many({"label": {"$lt": 5}}, {"$push": {"embedding": {"$each": [9.0], "$position": 1, "$slice": 3}}}),
    "SELECT vec_id, CASE WHEN label < 5 THEN [embedding[1], 9.0::FLOAT, embedding[2]] ELSE embedding END AS embedding, label FROM embeddings",
)
add_write(
    "update_pull", "embeddings", lambda c: c.update_many({}, {"$pull": {"embedding": {"$lt": 0}}}),
    "SELECT vec_id, list_filter(embedding, lambda x: x >= 0) AS embedding, label FROM embeddings",
)
add_write(
    "update_add_to_set", "embeddings", lambda c: c.update_many({}, {"$addToSet": {"embedding": {"$each": [7.0, 7.0]}}}),
    "SELECT vec_id, list_append(embedding, 7.0::FLOAT) AS embedding, label FROM embeddings",
)
add_write("update_counts", "orders", lambda c: counts(c, c.update_many({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "Q"}}), "matched_count"), "SELECT count(*)::BIGINT AS matched_count FROM orders WHERE o_orderstatus = 'P'")
add_write(
    "update_modified_count", "orders", lambda c: counts(c, c.update_many({"o_orderstatus": {"$in": ["F", "P"]}}, {"$set": {"o_orderstatus": "P"}}), "matched_count", "modified_count"),
    "SELECT count(*)::BIGINT AS matched_count, count(*) FILTER (o_orderstatus = 'F') AS modified_count FROM orders WHERE o_orderstatus IN ('F', 'P')",
)
add_write(
    "update_noop_id", "nation", lambda c: counts(c, c.update_many({"n_nationkey": 7}, {"$set": {"n_nationkey": 7}}), "matched_count", "modified_count"),
    "SELECT count(*)::BIGINT AS matched_count, 0::BIGINT AS modified_count FROM nation WHERE n_nationkey = 7",
)


def null_parent(c: Collection) -> DataFrame:
    """Fields set below documents that some rows don't have."""
    spread = F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b")))
    other = c.database.collection("spread")
    other.create_from_frame(c.frame().select("n_nationkey", spread.alias("d")), ["n_nationkey"], null_means="missing")
    other.update_many({"n_nationkey": {"$lt": 20}}, {"$set": {"d.a": 50}, "$inc": {"d.c": 2}})
    return other.frame().select("n_nationkey", "d.a", "d.b", "d.c")


add_write(
    "update_null_parent", "nation", null_parent,
    "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 50 WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS b, CASE WHEN n_nationkey < 20 THEN 2 END AS c FROM nation",
)


def upsert_rows(c: Collection) -> None:
    c.update_one({"r_regionkey": 99}, {"$set": {"r_name": "NOWHERE"}}, upsert=True)
    c.update_one({"r_regionkey": 0}, {"$set": {"r_name": "FIRST"}, "$setOnInsert": {"r_regionkey": 77}}, upsert=True)
    c.insert_many([{"r_regionkey": 50, "r_name": "FIFTY"}, {"r_regionkey": 51}])
    try:
        c.insert_many([{"r_regionkey": 50}, {"r_regionkey": 52, "r_name": "LAST"}], ordered=False)
    except BulkWriteError as e:
        c.insert_one({"r_regionkey": e.code})


add_write(
    "upsert_typed", "region", upsert_rows,
    "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'FIRST' ELSE r_name END AS r_name FROM region UNION ALL SELECT * FROM (VALUES (99, 'NOWHERE'), (50, 'FIFTY'), (51, NULL), (52, 'LAST'), (11000, NULL))",
)
add_write("update_one_without_ids", "lineitem", lambda c: counts(c, c.update_one({"l_quantity": {"$gt": 49}}, {"$set": {"l_comment_new": "x"}}) | {"n": c.count_documents({"l_comment_new": "x"})}, "modified_count", "n"), "SELECT 1::BIGINT AS modified_count, 1::BIGINT AS n")
add_write("delete_one_without_ids", "lineitem", lambda c: counts(c, c.delete_one({"l_quantity": {"$gt": 49}}) | {"n": c.count_documents()}, "deleted_count", "n"), "SELECT 1::BIGINT AS deleted_count, count(*) - 1 AS n FROM lineitem")


def push_sorted(c: Collection) -> DataFrame:
    """Documents pushed onto arrays of documents and sorted by two of their fields."""
    orders = run_pipeline(natural(c.frame(), ["o_orderkey"]), parse_pipeline([{"$match": {"o_custkey": {"$lte": 40}}}, ITEMS]))
    other = c.database.collection("by_customer")
    other.create_from_frame(orders, ["_id"])
    other.update_many({}, {"$push": {"items": {"$each": [{"k": 0, "p": 5.0, "s": "N"}], "$sort": {"s": -1, "p": 1}, "$slice": 3}}})
    return other.frame().select("_id", F.col("items.k").alias("keys"))


add_write(
    "update_push_sort", "orders", push_sorted,
    "SELECT o_custkey AS _id, list(k ORDER BY s DESC, p)[1:3] AS keys FROM (SELECT o_custkey, o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_custkey <= 40 UNION ALL SELECT DISTINCT o_custkey, 0, 5.0, 'N' FROM orders WHERE o_custkey <= 40) GROUP BY 1",
)


def two_writers(c: Collection) -> None:
    """Two writers of one collection at once: the one that is second reads again."""
    again = c.database.client.db().collection(c.name)
    jobs = [threading.Thread(target=w.insert_frame, args=(c.frame().withColumn("n_nationkey", F.col("n_nationkey") + shift),)) for w, shift in ((c, 100), (again, 200))]
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()


add_write("concurrent_writers", "nation", two_writers, "SELECT n_nationkey + shift AS n_nationkey, n_name, n_regionkey FROM nation, (VALUES (0), (100), (200)) t(shift)")


def catalog(c: Collection) -> DataFrame:
    """Collections and indexes that are left after some were made, renamed and dropped."""
    db, frame = c.database, c.frame()
    for name in ("a", "b"):
        db.collection(name).create_from_frame(frame, ["r_regionkey"])
    db.rename_collection("a", "z")
    db.collection("b").drop()
    c.create_index({"r_name": 1}, unique=True)
    c.create_index([("r_name", -1), ("r_regionkey", 1)], name="both")
    c.create_index({"r_regionkey": -1})
    c.drop_index("r_regionkey_-1")
    rows = [("collection", x["name"], db.collection(x["name"]).count_documents()) for x in db.list_collections()] + [("index", x["name"], len(x["key"])) for x in c.list_indexes()]
    return c.spark.createDataFrame(rows, "kind string, name string, n long")


add_write(
    "catalog", "region", catalog,
    "SELECT 'collection' AS kind, unnest(['region', 'z']) AS name, count(*)::BIGINT AS n FROM region UNION ALL SELECT * FROM (VALUES ('index', '_id_', 1), ('index', 'r_name_1', 1), ('index', 'both', 2))",
)


def read_cursor(c: Collection) -> DataFrame:
    """A cursor read step by step, to its end."""
    cursor = c.find({"c_acctbal": {"$lt": 1000}}).sort([("c_acctbal", -1), ("c_custkey", 1)]).limit(12)
    rows = [(1, cursor.next()["c_custkey"])]
    while cursor.has_next():
        rows.append((len(rows) + 1, cursor.next()["c_custkey"]))
    closed = c.find({})
    closed.close()
    return c.spark.createDataFrame(rows if cursor.next() is None and not closed.has_next() else [], "place int, c_custkey long")


add_write("cursor_reading", "customer", read_cursor, "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS place, c_custkey::BIGINT AS c_custkey FROM customer WHERE c_acctbal < 1000 ORDER BY 1 LIMIT 12")


def error_codes(c: Collection) -> DataFrame:
    """What is rejected, with which code; null for what is outside the supported surface."""
    tries: dict[str, Callable[[], Any]] = {
        "unknown operator": lambda: c.find({"n_name": {"$foo": 1}}), "empty $or": lambda: c.find({"$or": []}), "two fields in a stage": lambda: c.aggregate([{"$match": {}, "$limit": 1}]),
        "negative limit": lambda: c.aggregate([{"$limit": -1}]), "mixed projection": lambda: c.aggregate([{"$project": {"n_name": 1, "n_regionkey": 0}}]), "changed id": lambda: c.update_many({}, {"$set": {"n_nationkey": -1}}),
        "increased text": lambda: c.update_many({}, {"$inc": {"n_name": 1}}), "conflicting paths": lambda: c.update_many({}, {"$set": {"a": 1, "a.b": 2}}), "renamed into itself": lambda: c.update_many({}, {"$rename": {"n_name": "n_name.x"}}),
        "repeated row": lambda: c.insert_frame(c.frame()), "index options": lambda: [c.create_index({"n_name": 1}, name=n) for n in ("x", "y")], "missing index": lambda: c.drop_index("none"), "renamed to itself": lambda: c.rename(c.name),
        "unsupported stage": lambda: c.aggregate([{"$lookup": {}}]), "unsupported accumulator": lambda: c.aggregate([{"$group": {"_id": None, "x": {"$stdDevPop": "$n_nationkey"}}}]), "unsupported update": lambda: c.update_many({}, {"$mul": {"n_nationkey": 2}}),
    }
    found = []
    for what, attempt in tries.items():
        try:
            attempt()
        except QueryError as e:
            found.append((what, None if isinstance(e, NotSupported) else e.code))
    rest = c.count_documents()
    return c.spark.createDataFrame([(*f, rest) for f in found], "what string, code int, n long")


add_write(
    "error_codes", "nation", error_codes,
    "SELECT what, code, count(*)::BIGINT AS n FROM nation, (VALUES ('unknown operator', 2), ('empty $or', 2), ('two fields in a stage', 40323), ('negative limit', 5107201), ('mixed projection', 31254), ('changed id', 66), ('increased text', 14), ('conflicting paths', 40), ('renamed into itself', 2), ('repeated row', 11000), ('index options', 85), ('missing index', 27), ('renamed to itself', 20), ('unsupported stage', NULL), ('unsupported accumulator', NULL), ('unsupported update', NULL)) t(what, code) GROUP BY ALL",
)
add_write("delete_many", "orders", lambda c: c.delete_many({"o_totalprice": {"$lt": 200000}}) and None, "SELECT * FROM orders WHERE o_totalprice >= 200000")
add_write("delete_one", "nation", lambda c: c.delete_one({"n_regionkey": 1}) and None, "SELECT * FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)")
add_write("count_documents_skip_limit", "orders", lambda c: counts(c, {"n": c.count_documents({"o_orderstatus": "F"}, skip=10, limit=50)}, "n"), "SELECT least(greatest(count(*) - 10, 0), 50)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F'")
add_write("bulk_load", "lineitem", lambda c: None, "SELECT * FROM lineitem")
add_write("count_documents_all", "orders", lambda c: counts(c, {"n": c.count_documents()}, "n"), "SELECT count(*)::BIGINT AS n FROM orders")
add_write("find_sort_skip_limit", "customer", lambda c: c.find({"c_acctbal": {"$gt": 0}}).sort({"c_name": -1}).skip(5).limit(9).frame(), "SELECT * FROM customer WHERE c_acctbal > 0 ORDER BY c_name DESC, c_custkey LIMIT 9 OFFSET 5")
add_write("find_one", "customer", lambda c: c.find({"c_mktsegment": "BUILDING"}).limit(1).frame(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")


def mixed(spark: SparkSession, sf_dir: str, pipeline: list[dict], schema: str) -> DataFrame:
    """nation as documents of mixed shapes: the region of every third one is text, of every fifth one absent; read back as columns."""
    row = F.concat(
        F.lit('{"_id":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('"'),
        F.when(F.col("n_nationkey") % 5 == 0, "").when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(',"r":"'), F.col("n_regionkey").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit(',"r":'), F.col("n_regionkey").cast("string"))), F.lit("}"),
    )
    docs = each(table(spark, sf_dir, "nation").select(F.lit(b"").alias("ord"), row.alias("doc")), with_natural_order)
    return run_documents(Documents(docs), parse_pipeline(pipeline)).select(F.from_json("doc", schema).alias("d")).select("d.*")


def with_natural_order(_: bytes, d: dict) -> list[tuple[bytes, dict]]:
    return [(order_key(d["_id"]), d)]


def add_mixed(key: str, pipeline: list[dict], schema: str, sql: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: mixed(spark, sf_dir, pipeline, schema)
    ORACLES[key] = sql


add_mixed("mixed_match_bracket", [{"$match": {"r": {"$gte": 2}}}, {"$project": {"name": 1, "_id": 0}}], "name string", "SELECT n_name AS name FROM nation WHERE n_regionkey >= 2 AND n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0")
add_mixed("mixed_match_missing", [{"$match": {"r": None}}, {"$project": {"name": 1, "_id": 0}}], "name string", "SELECT n_name AS name FROM nation WHERE n_nationkey % 5 = 0")
add_mixed("mixed_exists_type", [{"$match": {"r": {"$type": "string"}}}, {"$count": "n"}], "n long", "SELECT count(*)::BIGINT AS n FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0")
add_mixed(
    "mixed_group", [{"$group": {"_id": None, "sum": {"$sum": "$r"}, "n": {"$count": {}}, "max": {"$max": "$r"}}}, {"$project": {"_id": 0}}], "sum long, n long, max string",
    "SELECT coalesce(sum(n_regionkey) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0), 0)::BIGINT AS sum, count(*)::BIGINT AS n, max(n_regionkey::VARCHAR) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0) AS max FROM nation",
)
add_mixed(
    "mixed_sort", [{"$sort": {"r": -1, "_id": 1}}, {"$skip": 2}, {"$limit": 9}, {"$project": {"name": 1, "_id": 0}}], "name string",
    "SELECT n_name AS name FROM nation ORDER BY CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END DESC, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END DESC, n_nationkey LIMIT 9 OFFSET 2",
)

# Writes of documents: a scratch collection of mixed types, read back as columns.


def add_documents(key: str, write: Callable[[Collection], None], schema: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Client(spark, f"{scratch_folder(spark)}/scratch-{uuid.uuid4().hex}").db().collection("documents")
        write(c)
        return c.frame().select(F.from_json("doc", schema).alias("d")).select("d.*")

    QUERIES[key] = run
    ORACLES[key] = sql


def insert_unordered(c: Collection) -> None:
    """Ten documents of which four have new ids."""
    try:
        c.insert_many([{"_id": i % 4, "n": i} for i in range(10)], ordered=False)
    except BulkWriteError as e:
        c.insert_one({"_id": 100, "n": len(e.write_errors)})


def insert_ordered(c: Collection) -> None:
    try:
        c.insert_many([{"_id": 1}, {"_id": 2}, {"_id": 2}, {"_id": 3}])
    except BulkWriteError as e:
        c.insert_one({"_id": e.code})


def violate_unique(c: Collection) -> None:
    c.create_index({"login": 1}, unique=True)
    c.insert_many([{"_id": 1, "login": "a"}, {"_id": 2, "login": ["b", "c"]}])
    for i, login in enumerate(("c", "d", "a")):
        try:
            c.insert_one({"_id": 10 + i, "login": login})
        except QueryError as e:
            c.insert_one({"_id": e.code + i, "login": f"refused {login}"})


def upsert(c: Collection) -> None:
    c.update_one({"_id": 1, "a": 2, "z": {"$gt": 5}}, {"$set": {"b": 3}, "$setOnInsert": {"c": 4}}, upsert=True)
    c.update_one({"_id": 1}, {"$inc": {"a": 10}, "$setOnInsert": {"c": 0}}, upsert=True)


def update_arrays(c: Collection) -> None:
    c.insert_many([{"_id": i, "t": [*range(i)]} for i in range(1, 5)])
    c.update_many({"t": {"$size": 3}}, {"$push": {"t": {"$each": [9, 8], "$sort": -1, "$slice": 3}}})
    c.update_many({"t": 3}, {"$pull": {"t": {"$lt": 2}}})
    c.update_many({"_id": {"$lte": 2}}, {"$addToSet": {"t": {"$each": [0, 7]}}})


add_documents("insert_many_unordered", insert_unordered, "_id long, n long", "SELECT range AS _id, range AS n FROM range(4) UNION ALL SELECT 100, 6")
add_documents("insert_many_ordered", insert_ordered, "_id long", "SELECT unnest([1, 2, 11000])::BIGINT AS _id")
add_documents("unique_violation", violate_unique, "_id long, login string", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, '[\"b\",\"c\"]'), (11000, 'refused c'), (11, 'd'), (11002, 'refused a')) t(_id, login)")
add_documents("update_upsert", upsert, "_id long, a long, b long, c long", "SELECT 1::BIGINT AS _id, 12::BIGINT AS a, 3::BIGINT AS b, 4::BIGINT AS c")
add_documents("update_arrays", update_arrays, "_id long, t array<long>", "SELECT * FROM (VALUES (1::BIGINT, [0, 7]::BIGINT[]), (2, [0, 1, 7]::BIGINT[]), (3, [9, 8, 2]::BIGINT[]), (4, [2, 3]::BIGINT[])) t(_id, t)")


def add_table_documents(key: str, name: str, write: Callable[[Collection, list[dict]], None], schema: str, sql: str) -> None:
    """As add_documents(), from all rows of a small table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Client(spark, f"{scratch_folder(spark)}/scratch-{uuid.uuid4().hex}").db().collection("documents")
        write(c, [r.asDict() for r in table(spark, sf_dir, name).orderBy(*IDS[name]).collect()])
        return c.frame().select(F.from_json("doc", schema).alias("d")).select("d.*")

    QUERIES[key] = run
    ORACLES[key] = sql


def insert_nations(c: Collection, rows: list[dict]) -> None:
    """All nations, then those of two regions again beside new ones: the repeated ones are refused."""
    c.insert_many([{"_id": r["n_nationkey"], "name": r["n_name"]} for r in rows])
    try:
        c.insert_many([{"_id": r["n_nationkey"] + 1000 * (r["n_regionkey"] > 1), "name": r["n_name"]} for r in rows], ordered=False)
    except BulkWriteError as e:
        c.insert_one({"_id": -1, "name": f"{len(e.write_errors)} refused"})


def one_per_region(c: Collection, rows: list[dict]) -> None:
    c.create_index({"region": 1}, unique=True)
    try:
        c.insert_many([{"_id": r["n_nationkey"], "region": [r["n_regionkey"], r["n_regionkey"] + 100]} for r in rows], ordered=False)
    except BulkWriteError:
        c.insert_one({"_id": 500, "region": 500})


def nations_of_regions(c: Collection, rows: list[dict]) -> None:
    groups: dict[int, list[int]] = {}
    for r in rows:
        groups.setdefault(r["n_regionkey"], []).append(r["n_nationkey"])
    c.insert_many([{"_id": k, "nations": v} for k, v in groups.items()])
    c.update_many({"_id": {"$lt": 3}}, {"$push": {"nations": {"$each": [90, 80], "$sort": -1, "$slice": 4}}})
    c.update_many({"nations": {"$gte": 20}}, {"$pull": {"nations": {"$lt": 10}}})
    c.update_one({"_id": 77, "kind": "new"}, {"$addToSet": {"nations": {"$each": [7, 7, 8]}}, "$setOnInsert": {"from": "upsert"}}, upsert=True)
    c.update_one({"_id": 77}, {"$addToSet": {"nations": {"$each": [8, 9]}}, "$setOnInsert": {"from": "nothing"}}, upsert=True)


add_table_documents(
    "insert_many_table", "nation", insert_nations, "_id long, name string",
    "SELECT n_nationkey::BIGINT AS _id, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_regionkey > 1 UNION ALL SELECT -1, count(*) || ' refused' FROM nation WHERE n_regionkey <= 1",
)
add_table_documents(
    "unique_violation_table", "nation", one_per_region, "_id long, region string",
    "SELECT min(n_nationkey)::BIGINT AS _id, '[' || n_regionkey || ',' || (n_regionkey + 100) || ']' AS region FROM nation GROUP BY n_regionkey UNION ALL SELECT 500, '500'",
)
add_table_documents(
    "update_arrays_table", "nation", nations_of_regions, "_id long, nations array<long>, kind string, from string",
    """WITH grouped AS (SELECT n_regionkey::BIGINT AS _id, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS l FROM nation GROUP BY 1),
pushed AS (SELECT _id, CASE WHEN _id < 3 THEN list_reverse_sort(list_concat(l, [90, 80]))[1:4] ELSE l END AS l FROM grouped)
SELECT _id, CASE WHEN list_max(l) >= 20 THEN list_filter(l, lambda x: x >= 10) ELSE l END AS nations, NULL AS kind, NULL AS "from" FROM pushed UNION ALL SELECT 77, [7, 8, 9], 'new', 'upsert'""",
)
