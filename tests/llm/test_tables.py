"""Sharding, URL lists, the registered queries and the pipeline."""

import os
import zlib
from collections import Counter
from datetime import date

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from docloom.llm import url_lists
from docloom.llm.queries import ORACLES, QUERIES
from docloom.llm.common import checkpoint, spread_join
from docloom.llm.quality_rules import fit_rules
from docloom.llm.sharding import assign_shards
from docloom.llm.text_stats import all_stats, ratios
from docloom.llm.url_lists import judge_captures, validity
from tests.llm.test_classifiers import brute_stats, walked
from tests.llm.test_pairs import brute_labels, brute_leaks, words_shingles

DATA = "/root/testdata/sf0.001"


def jump(key, shards):
    state, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(spark, small_docs, edge_docs, no_docs, shards):
    for docs in (small_docs, edge_docs):
        source = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        got = assign_shards(docs, shards).collect()
        expected = Counter((d, len(t) + 16, zlib.crc32(t), jump(d or 0, shards), jump(d or 0, shards + 1)) for d, t in source)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == expected
        assert all(r["grown_shard"] in (r["shard"], shards) for r in got)
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert assign_shards(no_docs, shards).count() == 0


def test_negative_and_large_keys(spark):
    keys = [-1, -(2**63), 2**63 - 1, 0, 123456789012345]
    got = {r["doc_id"]: r["shard"] for r in assign_shards(spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string"), 40).collect()}
    assert got == {k: jump(k, 40) for k in keys}


def test_spread_join(spark):
    """A join with hot keys, clashing helper names and keys without a partner, against a plain one."""
    left = spark.createDataFrame([(1 if i % 3 else i, i, i % 5) for i in range(9000)], "k long, n_rows int, share int")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 9000, 2)] + [(1, "one")], "k long, n_shares string")
    spread = spread_join(checkpoint(left), right, "k")
    assert "share" in spread.columns and Counter(map(tuple, spread.select("k", "n_rows", "share", "n_shares").collect())) == Counter(map(tuple, left.join(right, "k").select("k", "n_rows", "share", "n_shares").collect()))
    binary = lambda df: df.withColumn("k", df["k"].cast("string").cast("binary"))
    assert spread_join(checkpoint(binary(left)), binary(right), "k").count() == spread.count() > 3000
    assert spread_join(checkpoint(left.filter("false")), right, "k").count() == 0 and spread_join(checkpoint(left), right, "k", "left").count() == 9000


ENTRIES = [
    ("l", "host", "a.com", "add", date(2020, 1, 10)), ("l", "host", "a.com", "add", date(2020, 1, 12)), ("l", "host", "a.com", "remove", date(2020, 2, 1)), ("l", "host", "a.com", "add", date(2020, 3, 1)),
    ("l", "host", "same.com", "add", date(2020, 1, 1)), ("l", "host", "same.com", "remove", date(2020, 1, 1)), ("m", "domain", "b.org", "add", date(2020, 1, 1)), ("n", "prefix", "c.net/x/y", "add", date(2020, 1, 1)), (None, "host", "z.com", "add", None),
]


def test_url_lists(spark, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, dated date")
    spans = {}
    for r in validity(entries).orderBy("since").collect():
        spans.setdefault((r["kind"], r["pattern"]), []).append((r["since"], r["until"]))
    assert spans == {("host", "a.com"): [(date(2020, 1, 10), date(2020, 2, 1)), (date(2020, 3, 1), None)], ("domain", "b.org"): [(date(2020, 1, 1), None)], ("prefix", "c.net/x/y"): [(date(2020, 1, 1), None)]}
    cases = [
        (1, "http://a.com/p", date(2020, 1, 9), 0), (2, "http://A.com:80", date(2020, 1, 10), 1), (3, "http://u@a.com/", date(2020, 1, 31), 1), (4, "http://a.com/", date(2020, 2, 1), 0), (5, "http://a.com/", date(2021, 1, 1), 1),
        (6, "http://x.a.com/", date(2021, 1, 1), 0), (7, "https://x.y.b.org/q", date(2020, 5, 5), 1), (8, "https://b.org", date(2020, 5, 5), 1), (9, "https://ab.org", date(2020, 5, 5), 0), (10, "http://c.net/x/y/z?q#f", date(2020, 5, 5), 1),
        (11, "http://c.net/x/yy", date(2020, 5, 5), 0), (12, "http://c.net/x/y/", date(2020, 5, 5), 1), (13, None, date(2020, 5, 5), 0), (14, "no url", date(2020, 5, 5), 0), (15, "http://a.com/", None, 0), (None, "http://b.org/", date(2020, 5, 5), 1), (16, "http://same.com", date(2020, 5, 5), 0),
    ]
    captures = spark.createDataFrame([(*c[:3], "extra", 1) for c in cases] + [(*cases[1][:3], "extra", 1)], "page_id long, url string, fetched date, blocked string, kind int")
    for most in (url_lists.BROADCAST_BYTES, 0):  # a list too large to broadcast
        monkeypatch.setattr(url_lists, "BROADCAST_BYTES", most)
        got = {r["page_id"]: (r["blocked"], r["n_matches"]) for r in judge_captures(captures, entries).collect()}
        assert got == {c[0]: (bool(c[3]), c[3]) for c in cases}
    assert judge_captures(captures.filter("false"), entries).count() == 0
    assert not any(r["blocked"] for r in judge_captures(captures, entries.filter("false")).collect())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracles(spark, key):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[key](spark, DATA)
    relation = con.sql(ORACLES[key])
    assert sorted(relation.columns) == sorted(df.columns)
    names = sorted(df.columns)
    assert Counter(str([r[n] for n in names]) for r in df.collect()) == Counter(str([dict(zip(relation.columns, r))[n] for n in names]) for r in relation.fetchall())


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < out.count() <= before
        before = out.count()
        if i < 4:
            assert out.columns == columns, name
            docs = out
    ids = {r["doc_id"] for r in out.collect()}
    assert ids == {r["doc_id"] for r in docs.collect()}
    assert ids == {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}


def test_pipeline_by_brute_force(spark):
    """Each stage's rows against plain Python over all that the stage before kept."""
    docs = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    plain = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    quality, copies, repeats, leaks, tokens = (f for _, f in corpus_pipeline.STAGES)

    model = fit_rules(frame(docs), labels)
    kept = []
    for r in docs:
        n, *_, often = brute_stats(r["text"])
        if n >= 50 and 100 * often <= 50 * n and walked(model, ratios(np.array([all_stats(r["text"])]))[0].tolist()) >= 0:
            kept.append(r)
    assert plain(quality(spark, frame(docs), DATA)) == sorted(repr(tuple(r.values())) for r in kept) and 0 < len(kept) < len(docs)

    sets = [words_shingles(r["text"]) for r in kept]
    labels_of = brute_labels(len(kept), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = {}
    for r, c in zip(kept, labels_of):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    one = [r for r, c in zip(kept, labels_of) if r["doc_id"] == least[c]]
    assert plain(copies(spark, frame(kept), DATA)) == sorted(repr(tuple(r.values())) for r in one) and len(one) < len(kept)

    first = {}
    for r in sorted(one, key=lambda r: r["doc_id"]):
        t = r["text"].encode()
        for a in range(len(t) - 49):
            first.setdefault(t[a : a + 50], r["doc_id"])
    cut = []
    for r in one:
        t = r["text"].encode()
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < r["doc_id"]:
                gone[a : a + 50] = True
        text = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.all():
            cut.append(r | {"text": text, "n_chars": len(text)} if gone.any() else r)
    assert plain(repeats(spark, frame(one), DATA)) == sorted(repr(tuple(r.values())) for r in cut) and cut != one

    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in cut], benchmark)}
    clean = [r for r in cut if r["doc_id"] not in found]
    assert plain(leaks(spark, frame(cut), DATA)) == sorted(repr(tuple(r.values())) for r in clean) and len(clean) < len(cut)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes() for r in clean}
    assert {r["doc_id"]: bytes(r["ids"]) for r in tokens(spark, frame(clean), DATA).collect()} == ids


def test_pipeline_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            out.count()
            assert i == 4 or out.columns == docs.columns, name
