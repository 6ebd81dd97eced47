"""Client, databases, collections and cursors.

A collection is either dynamic (documents of any shape, evaluated exactly) or typed (a DataFrame with a
schema, evaluated as columns). Inserting dictionaries makes a dynamic one, create_from_frame() a typed one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BulkWriteError, NotSupported, QueryError
from docloom.functions.matcher import branches, matches
from docloom.functions.updates import Change, apply_update, parse_update, upserted
from docloom.operators.dynamic import SCHEMA, Documents, each, filtered, from_documents, run_documents
from docloom.operators.ordering import direction
from docloom.operators.pipeline import natural, parse_pipeline, run_pipeline
from docloom.operators.updates import CHANGED, HIT, updated_frame
from docloom.plans.columns import FilterCompiler, known
from docloom.plans.expressions import HIDDEN
from docloom.plans.filters import parse_filter
from docloom.sources.store import Conflict, Store, check_name
from docloom.values import MISSING, ObjectId, equal, from_json, order_key, to_json


class Client:
    """A directory of databases. Options are validated; only compression has an effect, on new data files."""

    def __init__(self, spark: SparkSession, path: str, durability: str = "journal", cache_size: int = 64 << 20, compression: bool | str = True):
        if durability not in ("journal", "strict"):
            raise QueryError(2, "durability has to be 'journal' or 'strict'")
        if isinstance(cache_size, bool) or not isinstance(cache_size, int) or cache_size <= 0:
            raise QueryError(2, "cache_size has to be a positive number of bytes")
        self.spark, self.store = spark, Store(spark, path)
        self.codec = compression if isinstance(compression, str) else "zstd" if compression else "none"

    def db(self, name: str = "test") -> Database:
        return Database(self, check_name(name, "database"))

    def list_databases(self) -> list[str]:
        return [d for d in self.store.databases() if self.store.read(d)[1]["collections"]]

    def close(self) -> None:
        """Nothing is held open."""


class Database:
    def __init__(self, client: Client, name: str):
        self.client, self.name = client, name

    def collection(self, name: str) -> Collection:
        return Collection(self, check_name(name, "collection"))

    def change(self, edit: Callable[[dict], Any]) -> Any:
        """Edit the newest manifest; try again if another writer was first."""
        for _ in range(20):
            version, manifest = self.client.store.read(self.name)
            result = edit(manifest)
            try:
                self.client.store.commit(self.name, version, manifest)
                return result
            except Conflict:
                continue
        raise QueryError(112, "too many concurrent writes")

    def list_collections(self, filter_: dict | None = None, name_only: bool = False) -> list[dict]:
        node = parse_filter(filter_ or {})
        found = [{"name": n, "type": "collection"} | ({} if name_only else {"options": {}, "profile": c["profile"]}) for n, c in sorted(self.client.store.read(self.name)[1]["collections"].items())]
        return [d for d in found if matches(d, node)]

    def rename_collection(self, old: str, new: str, drop_target: bool = False) -> None:
        check_name(new, "collection")
        if old == new:
            raise QueryError(20, "Can't rename a collection to itself")

        def edit(manifest: dict) -> None:
            found = manifest["collections"]
            if old not in found:
                raise QueryError(26, f"Source collection {self.name}.{old} does not exist")
            if new in found and not drop_target:
                raise QueryError(48, "target namespace exists")
            found[new] = found.pop(old)

        self.change(edit)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Delete data and manifests that the newest version doesn't need and that are older than so many seconds."""
        return self.client.store.vacuum(self.name, older_than)

    def drop_database(self) -> bool:
        self.client.store.drop_folder(self.name)
        return True


class Cursor:
    """A lazy result: sort, skip and limit until the first read."""

    def __init__(self, make: Callable[[dict], DataFrame], read: Callable[[Any], Any]):
        self._make, self._read = make, read
        self._options: dict[str, Any] = {"sort": {}, "skip": 0, "limit": 0}
        self._rows: Iterator | None = None
        self._ahead: list = []
        self._closed = False

    def _set(self, name: str, value: Any) -> Cursor:
        if self._rows is not None:
            raise QueryError(2, "Cursor is already initialized")
        self._options[name] = value
        return self

    def sort(self, spec: Any, way: Any = 1) -> Cursor:
        return self._set("sort", sort_spec(spec, way))

    def skip(self, n: int) -> Cursor:
        return self._set("skip", whole(n, "skip"))

    def limit(self, n: int) -> Cursor:
        return self._set("limit", abs(whole(n, "limit", negative=True)))

    def allow_disk_use(self, allow: bool) -> Cursor:
        """Accepted: Spark spills by itself, so the error for exceeded memory is never raised."""
        if not isinstance(allow, bool):
            raise QueryError(2, "allow_disk_use has to be a boolean")
        return self._set("allow_disk_use", allow)

    def frame(self) -> DataFrame:
        """The result as a DataFrame."""
        return self._make(self._options)

    def _iterate(self) -> Iterator:
        if self._rows is None:
            self._rows = iter(()) if self._closed else map(self._read, self.frame().toLocalIterator())
        return self._rows

    def has_next(self) -> bool:
        if not self._ahead:
            self._ahead = [x for _, x in zip(range(1), self._iterate())]
        return bool(self._ahead)

    def next(self) -> Any:
        return self._ahead.pop() if self.has_next() else None

    def __iter__(self) -> Iterator:
        while self.has_next():
            yield self._ahead.pop()

    def to_list(self) -> list:
        if self._rows is None and not self._closed:
            self._rows = iter(())
            return [self._read(r) for r in self.frame().collect()]
        return list(self)

    def close(self) -> None:
        self._rows, self._ahead, self._closed = iter(()), [], True


def sort_spec(spec: Any, way: Any = 1) -> dict[str, bool]:
    """Descending or not by path, of a document, pairs, one pair, or one name."""
    if isinstance(spec, str):
        return {spec: direction(way)}
    if isinstance(spec, (list, tuple)) and len(spec) == 2 and isinstance(spec[0], str) and not isinstance(spec[1], (list, tuple)) and spec[1] in (1, -1, "asc", "desc", "ascending", "descending"):
        return {spec[0]: direction(spec[1])}
    if isinstance(spec, (list, tuple)):
        spec = {p[0]: p[1] for p in spec if isinstance(p, (list, tuple)) and len(p) == 2} if all(isinstance(p, (list, tuple)) for p in spec) else dict.fromkeys(spec, 1)
    if not isinstance(spec, dict):
        raise QueryError(2, "invalid sort specification")
    return {k: direction(v) for k, v in spec.items()}


def whole(n: Any, what: str, negative: bool = False) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or (n < 0 and not negative):
        raise QueryError(2, f"{what} has to be a non-negative whole number")
    return n


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name
        self.counted: dict[str, int] = {}
        self.spark, self.store = database.client.spark, database.client.store

    # -- reading -------------------------------------------------------------------------------------

    def _entry(self) -> dict | None:
        return self.store.read(self.database.name)[1]["collections"].get(self.name)

    def _frame(self, entry: dict | None) -> DataFrame:
        """The stored rows of one version."""
        schema = T.StructType.fromJson(json.loads(entry["schema"])) if entry and entry["schema"] else T._parse_datatype_string(SCHEMA)
        if not entry or not entry["segments"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*entry["segments"])

    def frame(self) -> DataFrame:
        """The rows of the newest version: columns of a typed collection, (ord, doc) of a dynamic one."""
        return self._frame(self._entry())

    def _run(self, stages: list[tuple[str, Any]]) -> DataFrame:
        entry = self._entry()
        df = self._frame(entry)
        if entry and entry["profile"] == "typed":
            return run_pipeline(natural(df, entry["ids"], entry["null_means"]), stages)
        return run_documents(Documents(df), stages)

    def _read(self, row: Any) -> Any:
        return from_json(row["doc"]) if row.__fields__ == ["ord", "doc"] else row.asDict(recursive=True)

    def find(self, filter_: dict | None = None, sort: Any = None, skip: int = 0, limit: int = 0, allow_disk_use: bool | None = None) -> Cursor:
        node = parse_filter(filter_)

        def make(o: dict) -> DataFrame:
            stages = [("$match", node)] + [("$sort", o["sort"])] * bool(o["sort"]) + [("$skip", o["skip"])] * bool(o["skip"]) + [("$limit", o["limit"])] * bool(o["limit"])
            return self._run(stages)

        cursor = Cursor(make, self._read)
        if sort is not None:
            cursor.sort(sort)
        return cursor.skip(skip).limit(limit)

    def find_one(self, filter_: dict | None = None) -> Any:
        return self.find(filter_).limit(1).next()

    def aggregate(self, pipeline: list[dict]) -> Cursor:
        stages = parse_pipeline(pipeline)

        def make(o: dict) -> DataFrame:
            return self._run(stages + [("$sort", o["sort"])] * bool(o["sort"]) + [("$skip", o["skip"])] * bool(o["skip"]) + [("$limit", o["limit"])] * bool(o["limit"]))

        return Cursor(make, self._read)

    def count_documents(self, filter_: dict | None = None, skip: int = 0, limit: int = 0) -> int:
        node = parse_filter(filter_)
        entry = self._entry()
        if entry is None:
            return 0
        n = entry["count"] if not filter_ else self._matching(entry, self._frame(entry), node).count()
        n = max(0, n - whole(skip, "skip"))
        return min(n, limit) if whole(limit, "limit") else n

    def _matching(self, entry: dict, df: DataFrame, node) -> DataFrame:
        return df.filter(FilterCompiler(df.schema, entry["null_means"]).compile(node)) if entry["profile"] == "typed" else filtered(df, node)

    # -- writing -------------------------------------------------------------------------------------

    def create_from_frame(self, df: DataFrame, ids: list[str], null_means: str = "null") -> None:
        """Make a typed collection of a DataFrame; ids are the columns that identify a row."""
        self._write(lambda entry: (df, entry is None), typed={"ids": ids, "null_means": null_means, "schema": df.schema.json()}, unique=True)

    def _blank(self, typed: dict | None = None) -> dict:
        entry = {"id": ObjectId().__str__(), "segments": [], "count": 0, "indexes": [], "profile": "dynamic", "ids": ["_id"], "null_means": "missing", "schema": None}
        return entry | (typed or {}) | ({"profile": "typed"} if typed else {})

    def _write(self, rows: Callable[[dict | None], tuple[DataFrame | None, bool]], typed: dict | None = None, unique: bool = False, needed: str | None = None) -> dict:
        """Write a segment and commit it; from the start again if another writer was first. rows(entry) -> (rows, whether they are added to the others).

        Rows are counted while they are written, and so are those whose HIT and CHANGED are true (self.counted). Nothing is committed if `needed` of these is 0.
        """
        for _ in range(20):
            version, manifest = self.store.read(self.database.name)
            entry = manifest["collections"].get(self.name)
            if typed and entry is not None:
                raise QueryError(48, f"collection {self.name} exists")
            df, added = rows(entry)
            entry = entry or self._blank(typed)
            manifest["collections"][self.name] = entry
            if df is None:
                entry["segments"], entry["count"] = [], 0
            else:
                path = self.store.new_segment(self.database.name, entry["id"])
                seen = Observation()
                totals = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`")).alias(c) for c in (HIT, CHANGED) if c in df.columns)]
                df.observe(seen, *totals).drop(HIT, CHANGED).write.option("compression", self.database.client.codec).parquet(path)
                self.counted = seen.get
                n = self.counted["rows"]
                if needed and not self.counted[needed]:
                    self.store.drop_path(path)
                    return entry
                entry["segments"] = [*entry["segments"], path] if added else [path]
                entry["count"] = entry["count"] + n if added else n
                if entry["profile"] == "typed" and not added:
                    entry["schema"] = self.spark.read.parquet(path).schema.json()
            try:
                if unique:
                    self._check_unique(entry)
                self.store.commit(self.database.name, version, manifest)
                return entry
            except (Conflict, QueryError) as e:
                if df is not None:
                    self.store.drop_path(path)
                if isinstance(e, QueryError):
                    raise
        raise QueryError(112, "too many concurrent writes")

    def _index_keys(self, entry: dict) -> list[tuple[str, list[str]]]:
        return [("_id_", entry["ids"]), *((i["name"], list(i["key"])) for i in entry["indexes"] if i["unique"])]

    def _keyed(self, entry: dict, df: DataFrame, paths: list[str], name: str) -> DataFrame:
        """(row, key) for each distinct index key of each document: every array element, missing as null."""
        if entry["profile"] == "typed":
            row = f"{HIDDEN}row"
            marked = df.withColumn(row, F.monotonically_increasing_id())
            cols = []
            for i, p in enumerate(paths):
                col, kind = F.col(f"`{p}`") if p in df.columns else F.lit(None), df.schema[p].dataType if p in df.columns else None
                marked = marked.withColumn(f"{HIDDEN}k{i}", F.explode_outer(F.array_distinct(col)) if isinstance(kind, T.ArrayType) else col)
                cols.append(F.col(f"`{HIDDEN}k{i}`"))
            return marked.select(F.col(f"`{row}`").cast("string").alias("row"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("key")).distinct()
        keys = each(df, lambda order, d: ((order, k.hex()) for k in document_keys(d, paths, name)))
        key = F.regexp_replace("doc", '"', "").alias("key")  # a JSON string of hexadecimal digits
        if name == "_id_":  # a repeated document would be the same row and key
            return keys.select(F.monotonically_increasing_id().cast("string").alias("row"), key)
        return keys.select(F.hex("ord").alias("row"), key).distinct()

    def _check_unique(self, entry: dict) -> None:
        df = self._frame(entry)
        for name, paths in self._index_keys(entry):
            if not paths:
                continue
            twice = self._keyed(entry, df, paths, name).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
            if twice:
                raise duplicate(self.name, name, paths, twice[0]["key"])

    def insert_one(self, doc: dict) -> dict:
        try:
            return {"acknowledged": True, "inserted_id": self.insert_many([doc])["inserted_ids"][0]}
        except BulkWriteError as e:
            first = e.write_errors[0]
            raise QueryError(first["code"], first["errmsg"], first.get("key_pattern"), first.get("key_value")) from None

    def insert_many(self, docs: list[dict], ordered: bool = True) -> dict:
        """Add documents. Ordered: those before the first failure stay; unordered: all that don't fail."""
        if not isinstance(docs, (list, tuple)) or not docs:
            raise QueryError(2, "documents must be a nonempty list")
        prepared = []
        for d in docs:
            if not isinstance(d, dict):
                raise QueryError(2, "a document has to be an object")
            if isinstance(d.get("_id"), (list, re.Pattern)):
                raise QueryError(2, "The '_id' value cannot be an array or a regular expression")
            prepared.append({"_id": d["_id"] if "_id" in d else ObjectId(), **{k: v for k, v in d.items() if k != "_id"}})
        result: dict[str, Any] = {}

        def rows(entry: dict | None) -> tuple[DataFrame | None, bool]:
            if entry and entry["profile"] == "typed":
                new = self._typed_rows(entry, docs)
                keys = {}
                for name, paths in self._index_keys(entry):
                    keys[name] = [[] for _ in docs]
                    for r in self._keyed(entry, new, paths, name).collect() if paths else ():
                        keys[name][int(r["row"])].append(r["key"])
                kept, errors = self._accepted(entry, docs, ordered, keys)
                ids = [{i: d.get(i) for i in entry["ids"]} for d in docs]
                result.update(inserted={i: ids[i] if len(ids[i]) != 1 else next(iter(ids[i].values())) for i in kept}, errors=errors)
                return self._typed_rows(entry, [docs[i] for i in kept]), True
            kept, errors = self._accepted(entry or self._blank(), prepared, ordered)
            result.update(inserted={i: prepared[i]["_id"] for i in kept}, errors=errors)
            return from_documents(self.spark, [prepared[i] for i in kept]).coalesce(1 + len(kept) // 100_000), True

        self._write(rows)
        if result["errors"]:
            raise BulkWriteError(result["errors"][0]["errmsg"], len(result["inserted"]), result["errors"])
        return {"acknowledged": True, "inserted_count": len(result["inserted"]), "inserted_ids": result["inserted"]}

    def _typed_rows(self, entry: dict, docs: list[dict]) -> DataFrame:
        """Documents as rows of a typed collection, in one partition; a field it doesn't have is rejected, an absent one is null."""
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        for d in docs:
            if unknown := set(d) - set(schema.names):
                raise NotSupported(f"the new field {sorted(unknown)[0]!r} in a typed collection")
        try:
            return self.spark.createDataFrame([tuple(d.get(n) for n in schema.names) for d in docs], T.StructType([T.StructField(f.name, f.dataType) for f in schema])).coalesce(1)
        except (PySparkTypeError, PySparkValueError) as e:
            raise NotSupported(f"a value of another type in a typed collection: {e}") from None

    def _accepted(self, entry: dict, docs: list[dict], ordered: bool, keys: dict[str, list[list[str]]] | None = None) -> tuple[list[int], list[dict]]:
        """Positions of the documents that no unique key rejects, and the errors of the others. Only the batch's own keys are looked up."""
        taken: dict[str, set[str]] = {}
        wanted = keys or {name: [[k.hex() for k in document_keys(d, paths, name)] for d in docs] for name, paths in self._index_keys(entry)}
        if entry["segments"]:
            df = self._frame(entry)
            for name, paths in self._index_keys(entry):
                if not paths:
                    continue
                asked = self.spark.createDataFrame([(k,) for k in {k for ks in wanted[name] for k in ks}], "key string")
                taken[name] = {r["key"] for r in self._keyed(entry, df, paths, name).join(F.broadcast(asked), "key", "left_semi").select("key").distinct().collect()}
        kept, errors = [], []
        for i in range(len(docs)):
            clash = next((name for name, _ in self._index_keys(entry) if set(wanted[name][i]) & taken.setdefault(name, set())), None)
            if clash is None:
                kept.append(i)
                for name in taken:
                    taken[name].update(wanted[name][i])
                continue
            paths = dict(self._index_keys(entry))[clash]
            error = duplicate(self.name, clash, paths, {p: docs[i].get(p) for p in paths})
            errors.append({"index": i, "code": error.code, "errmsg": str(error), "key_pattern": error.key_pattern, "key_value": error.key_value})
            if ordered:
                break
        return kept, errors

    def insert_frame(self, df: DataFrame) -> int:
        """Append the rows of a DataFrame to a typed collection; nothing is added if a unique key is violated."""
        entry = self._entry()
        if entry is None or entry["profile"] != "typed":
            raise NotSupported("appending a DataFrame to a collection that isn't typed")
        names = T.StructType.fromJson(json.loads(entry["schema"])).names
        return self._write(lambda e: (df.select(*names), True), unique=True)["count"] - entry["count"]

    def delete_many(self, filter_: dict | None = None) -> dict:
        return self._delete(filter_, one=False)

    def delete_one(self, filter_: dict | None = None) -> dict:
        return self._delete(filter_, one=True)

    def _delete(self, filter_: dict | None, one: bool) -> dict:
        node, entry = parse_filter(filter_), self._entry()
        if entry is None:
            return {"acknowledged": True, "deleted_count": 0}
        if not filter_ and not one:
            self._write(lambda e: (None, False))
            return {"acknowledged": True, "deleted_count": entry["count"]}
        before: list[int] = []

        def rows(e: dict | None) -> tuple[DataFrame, bool]:
            df = self._frame(e)
            before.append(e["count"])
            if e["profile"] == "typed":
                hit = self._hit_one(e, df, node) if one else FilterCompiler(df.schema, e["null_means"]).compile(node)
                return df.filter(~known(hit)), False
            first = filtered(df, node).agg(F.min("ord")).first()[0] if one else None
            kept = df.filter(F.col("ord") != F.lit(first)) if first is not None else df if one else each(df, lambda o, d: () if matches(d, node) else ((o, d),))
            return kept, False

        after = self._write(rows)["count"]
        return {"acknowledged": True, "deleted_count": before[-1] - after}

    def _hit_one(self, entry: dict, df: DataFrame, node):
        """A condition that only the first matching row meets; without ids the first one by its place in the files."""
        if not entry["ids"]:
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            first = df.filter(FilterCompiler(df.schema, entry["null_means"]).compile(node)).agg(F.min(place).alias("at")).first()["at"] if entry["segments"] else None
            return place.eqNullSafe(F.struct(F.lit(first["file"]).alias("file"), F.lit(first["row"]).cast("long").alias("row"))) if first else F.lit(False)
        first = run_pipeline(natural(df, entry["ids"], entry["null_means"]), [("$match", node), ("$limit", 1)]).select(*entry["ids"]).collect()
        if not first:
            return F.lit(False)
        out = F.lit(True)
        for name in entry["ids"]:
            out = out & F.col(f"`{name}`").eqNullSafe(F.lit(first[0][name]))
        return out

    def update_many(self, filter_: dict, update: dict, upsert: bool = False) -> dict:
        return self._update(filter_, update, upsert, one=False)

    def update_one(self, filter_: dict, update: dict, upsert: bool = False) -> dict:
        return self._update(filter_, update, upsert, one=True)

    def _update(self, filter_: dict, update: dict, upsert: bool, one: bool) -> dict:
        """All matching documents are changed, or none if a change fails."""
        node, changes, entry = parse_filter(filter_), parse_update(update), self._entry()
        matched = 0
        if entry is not None and entry["profile"] == "typed":
            return self._update_typed(filter_ or {}, node, changes, upsert, one)
        if entry is not None:
            matched = self._matching(entry, self._frame(entry), node).limit(1).count() if one else self._matching(entry, self._frame(entry), node).count()
        done = {"acknowledged": True, "matched_count": matched, "modified_count": 0, "upserted_count": 0, "upserted_id": None}
        if not matched:
            if upsert:
                doc = upserted(filter_ or {}, changes, ObjectId())
                self.insert_one(doc)
                done.update(upserted_count=1, upserted_id=doc["_id"])
            return done
        modified: list[int] = []

        def rows(e: dict | None) -> tuple[DataFrame, bool]:
            df = self._frame(e)
            only = filtered(df, node).agg(F.min("ord")).first()[0] if one else None
            only = bytes(only) if only is not None else None

            def change(order: bytes, d: dict):
                if (order == only) if one else matches(d, node):
                    d = apply_update(d, changes)
                return ((order, d),)

            def differs(order: bytes, d: dict):
                hit = (order == only) if one else matches(d, node)
                return ((order, d),) if hit and not equal(apply_update(d, changes), d) else ()

            try:
                modified.append(each(df, differs).count())
                return each(df, change), False
            except Exception as e2:
                raise update_error(e2) from None

        try:
            self._write(rows, unique=bool(entry["indexes"]))
        except QueryError:
            raise
        except Exception as e:
            raise update_error(e) from None
        return done | {"modified_count": modified[-1]}

    def _update_typed(self, filter_: dict, node, changes: list[Change], upsert: bool, one: bool) -> dict:
        """One pass: rows are rewritten, and the matching and the changed ones counted, in the version that is committed."""

        def rows(e: dict | None) -> tuple[DataFrame, bool]:
            if e is None or e["profile"] != "typed":
                raise QueryError(112, "the collection was replaced meanwhile")
            df = self._frame(e)
            hit = self._hit_one(e, df, node) if one else FilterCompiler(df.schema, e["null_means"]).compile(node)
            return updated_frame(df, hit, changes, e["ids"], e["null_means"]), False

        try:
            indexed = any(i["unique"] for i in (self._entry() or {"indexes": []})["indexes"])
            self._write(rows, unique=indexed, needed=CHANGED)
        except QueryError:
            raise
        except Exception as e:
            raise update_error(e) from None
        matched, modified = self.counted[HIT], self.counted[CHANGED]
        done = {"acknowledged": True, "matched_count": matched, "modified_count": modified, "upserted_count": 0, "upserted_id": None}
        if upsert and not matched:
            doc = upserted(filter_, changes, None)
            if doc["_id"] is None and "_id" not in (self._entry() or {}).get("ids", []):
                doc.pop("_id")
            done.update(upserted_count=1, upserted_id=self.insert_one(doc)["inserted_id"])
        return done

    # -- indexes and administration ------------------------------------------------------------------

    def create_index(self, keys: Any, name: str | None = None, unique: bool = False) -> str:
        """Index metadata; a unique index is enforced on every write."""
        spec = {k: -1 if d else 1 for k, d in sort_spec(keys).items()}
        if not spec:
            raise QueryError(67, "Index keys cannot be empty.")
        name = name or "_".join(f"{k}_{v}" for k, v in spec.items())

        def edit(manifest: dict) -> str:
            entry = manifest["collections"].setdefault(self.name, self._blank())
            for i in entry["indexes"]:
                if list(i["key"]) == list(spec):
                    if i == {"name": name, "key": spec, "unique": unique}:
                        return name
                    raise QueryError(85, f"An index on the same fields exists with the name {i['name']} or other options")
                if i["name"] == name:
                    raise QueryError(86, f"An index with the name {name} exists on other fields")
            entry["indexes"].append({"name": name, "key": spec, "unique": unique})
            if (unique or entry["profile"] == "dynamic") and entry["segments"] and entry["segments"] != checked:
                self._check_unique(entry)
                checked[:] = entry["segments"]
            return name

        checked: list[str] = []  # the data that was found to have no repeated key: a retry doesn't look again

        if list(spec) == ["_id"]:
            return "_id_"
        return self.database.change(edit)

    def drop_index(self, which: Any) -> None:
        def edit(manifest: dict) -> None:
            entry = manifest["collections"].get(self.name)
            if entry is None:
                raise QueryError(26, "ns not found")
            if which == "_id_" or which == {"_id": 1}:
                raise QueryError(72, "cannot drop _id index")
            found = [i for i in entry["indexes"] if i["name"] == which or i["key"] == which]
            if not found:
                raise QueryError(27, f"index not found with name [{which}]")
            entry["indexes"] = [i for i in entry["indexes"] if i not in found]

        self.database.change(edit)

    def list_indexes(self) -> list[dict]:
        entry = self._entry()
        if entry is None:
            raise QueryError(26, f"ns does not exist: {self.database.name}.{self.name}")
        return [{"name": "_id_", "key": {"_id": 1}}] + [{"name": i["name"], "key": i["key"]} | ({"unique": True} if i["unique"] else {}) for i in entry["indexes"]]

    def drop(self) -> bool:
        def edit(manifest: dict) -> dict | None:
            return manifest["collections"].pop(self.name, None)

        entry = self.database.change(edit) if self._entry() else None
        if entry:
            self.store.drop_folder(self.database.name, entry["id"])
        return entry is not None

    def rename(self, new: str, drop_target: bool = False) -> Collection:
        self.database.rename_collection(self.name, new, drop_target)
        return self.database.collection(new)


def document_keys(doc: dict, paths: list[str], name: str) -> list[bytes]:
    """The distinct keys of a document in an index; an array gives one per element, an absent field null."""
    if name == "_id_":
        return [order_key(doc.get("_id", MISSING))]
    parts, arrays = [], 0
    for p in paths:
        values: list[Any] = []
        many = False
        for v, whole_ in branches(doc, tuple(p.split("."))):
            if isinstance(v, list) and not whole_:
                many = True
                values += v or [MISSING]
            else:
                values.append(v)
        many |= len(values) > 1
        arrays += many
        if arrays > 1:
            raise QueryError(171, "cannot index parallel arrays")
        parts.append(list(dict.fromkeys(order_key(v) for v in values or [MISSING])))
    out = [b""]
    for p in parts:
        out = [a + b for a in out for b in p]
    return list(dict.fromkeys(out))


def duplicate(collection: str, index: str, paths: list[str], value: Any) -> QueryError:
    shown = value if isinstance(value, str) else to_json(value)
    return QueryError(11000, f"E11000 duplicate key error collection: {collection} index: {index} dup key: {shown}", dict.fromkeys(paths, 1), value if isinstance(value, dict) else None)


def update_error(e: Exception) -> Exception:
    """The query error behind a failed task, if that's what it was."""
    found = re.search(r"(?:docloom\.errors\.QueryError:|\[USER_RAISED_EXCEPTION\]) (.*?)(?: SQLSTATE:.*)?$", str(e), re.M)
    for code, words in ((66, "immutable field"), (14, "non-numeric"), (28, "Cannot create field"), (2, "must be an array"), (2, "array element")):
        if found and words in found[1]:
            return QueryError(code, found[1].strip())
    return e
