"""Near-duplicates, repeated strings, benchmark leaks: against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docloom.llm import simhash_dedup, suffix_dedup
from docloom.llm.components import connected_components
from docloom.llm.decontaminate import RADIUS, find_leaks, with_fingerprint, without_leaks
from docloom.llm.near_copies import PAIRS, WORDS, codewords, distance, fingerprint_of, group_links, in_blocks, joined, keep_one, limits, linked, long_fingerprint, near, near_copies, segments
from docloom.llm.simhash_dedup import fingerprint, forest, golay_keys, link_by_midpoints, near_duplicates, nearby_errors
from docloom.llm.suffix_dedup import remove_repeats, without_repeats


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> component by row."""
    label = list(range(len(rows)))
    changed = True
    near = [[j for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2] for i in range(len(rows))]
    while changed:
        changed = False
        for i in range(len(rows)):
            least = min(label[j] for j in near[i])
            if least < label[i]:
                label[i], changed = least, True
    least = {}
    for (doc, _), c in zip(rows, label):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return [least.get(c) for c in label]


def test_golay_code():
    table = nearby_errors()
    assert (table[:, 0] >= 0).all() and set((table >= 0).sum(1)) == {1, 6}
    rng = random.Random(1)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.choice([0, 1, 2])):
            y ^= 1 << b
        keys = [set(golay_keys(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]


def test_near_duplicates(spark, small_docs, edge_docs, no_docs):
    for docs in (small_docs, edge_docs):
        rows = [(r["doc_id"], brute_fingerprint(r["text"] or "")) for r in docs.collect()]
        expected = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows)))
        assert Counter(map(tuple, near_duplicates(docs).collect())) == expected
    assert near_duplicates(no_docs).count() == 0


def words_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies(spark, edge_docs, no_docs):
    """Texts that share four fifths of their shingles end in one group; unrelated ones don't."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += texts[:5] + ["", "  ", "one", "one"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    sets = [words_shingles(t) for t in texts]
    similar = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) > 40 and all(got[i] == got[j] for i, j in similar)
    assert all(sets[i] & sets[c] or not sets[i] for i, c in got.items())
    kept = keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in got.items() if i == c}
    assert near_copies(edge_docs).count() == edge_docs.count() and near_copies(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def brute_labels(n, near):
    label = list(range(n))
    for i, j in combinations(range(n), 2):
        if label[i] != label[j] and near(i, j):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_large_group():
    """Links of a group beyond the small size: the same components as all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (3, WORDS), dtype=np.uint64)
    fps = np.repeat(base, 50, 0)
    for row in fps:
        for b in rng.choice(WORDS * 64, rng.integers(0, 70), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    sizes = np.full(len(fps), 100)
    a, b = linked(fps, sizes)
    parent = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        low, high = sorted((parent[x], parent[y]))
        parent = [low if p == high else p for p in parent]
    assert parent == brute_labels(len(fps), lambda i, j: distance(fps[i], fps[j]) <= limits()[100])
    assert len(group_links(0, np.repeat(base[:1], 2, 0), sizes[:2])[0]) == 1 and len(group_links(0, np.repeat(base[:1], 2, 0), np.array([100, 79]))[0]) == 0


@pytest.mark.parametrize(("paired", "in_task"), [(64, 50_000), (4, 50_000), (2, 20), (1, 3)])
def test_link_stream(monkeypatch, paired, in_task):
    """Small groups, groups linked in a task and groups too large for a task give the same components."""
    monkeypatch.setattr(simhash_dedup, "PAIRED", paired)
    monkeypatch.setattr(simhash_dedup, "IN_TASK", in_task)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for c in centres for _ in range(60)})
    signed = np.array(fps, np.uint64).view(np.int64)
    keys, owners = golay_keys(signed)
    order = np.argsort(keys, kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[order][i : i + 100]), pa.array(owners[order][i : i + 100])], ["key", "fp"]) for i in range(0, len(keys), 100)]
    edges, hot = [], set()
    for batch in simhash_dedup._link_stream(iter(batches)):
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hot.add(a) if b is None else edges.append((a, b))
    unsigned = lambda v: v & (1 << 64) - 1
    a, b = link_by_midpoints(np.array(sorted(hot), np.int64)) if hot else (np.zeros(0, np.int64),) * 2
    edges += list(zip(a.tolist(), b.tolist()))
    parent = {f: f for f in signed.tolist()}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        parent[find(x)] = find(y)
    linked = [(x, y) for x, y in combinations(signed.tolist(), 2) if (unsigned(x) ^ unsigned(y)).bit_count() <= 2]
    assert all(find(x) == find(y) for x, y in linked)
    groups = brute_components([(int(i), f) for i, f in enumerate(fps)])
    assert len({find(f) for f in signed.tolist()}) == len(set(groups))


def test_forest():
    a, b = forest(np.array([5, 1, 9, 7]), np.array([6, 5, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 1), (6, 1), (9, 8)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    found = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert found == {v: find(v) for u, w in edges for v in (u, w) if u != w}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if d is not None and first[t[s : s + 50]] < d:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def odd_repeats():
    rng = random.Random(4)
    line = "The very same line of more than fifty bytes, é, which many documents share. "
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += [rng.choice(["", "x", "yy " * 5]) + line[: rng.randint(45, len(line))] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += [line, line, "a" * 49, "a" * 50, "a" * 51, "a" * 300, "abc" * 70, "abc" * 80, "", line + line]
    return [*enumerate(texts), (3, line), (None, line), (7, None)]


def test_repeats(spark, small_docs, edge_docs, no_docs):
    made = spark.createDataFrame(odd_repeats(), "doc_id long, text string")
    for docs, wide in ((made, 2000), (made, 5), (made.repartition(7), 1), (small_docs, 2000), (small_docs.repartition(5), 1), (edge_docs, 2000)):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        assert Counter(map(tuple, remove_repeats(docs, wide=wide).collect())) == Counter(brute_repeats(rows))
    assert remove_repeats(no_docs).count() == 0


def suffix_steps(rows, parts=3, wide=2000):
    """The steps of remove_repeats() without Spark: (doc_id, text) -> result rows."""
    dedup = suffix_dedup

    def grouped(tables, schema, key):
        table = pa.Table.from_batches([b for t in tables for b in t.to_batches()], dedup.batch_of([], schema).schema)
        return {k: table.filter(pa.compute.equal(table.column(key), k)) for k in dict.fromkeys(table.column(key).to_pylist())}

    def table_of(batches):
        return [pa.Table.from_batches([b]) for b in batches]

    docs = pa.table({"id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    blocks = table_of(dedup._pack(iter(docs.to_batches(max_chunksize=4))))
    look_ups = table_of(dedup._look_up(2)(b for t in blocks for b in t.to_batches()))
    answers = grouped(map(dedup._answer, grouped(look_ups, dedup.LOOKUPS, "part").values()), dedup.ANSWERS, "block")
    nothing = lambda schema: pa.Table.from_batches([dedup.batch_of([], schema)])
    id_of = lambda t: t.column("block")[0].as_py()
    records = [dedup._record_rows(2, parts, wide)((), b, answers.get(id_of(b), nothing(dedup.ANSWERS))) for b in blocks]
    judged = map(dedup._judge(parts, wide), grouped(records, dedup.ROWS, "part").values())
    verdicts = grouped(map(dedup._judge_suffixes, grouped(judged, dedup.ROWS, "part").values()), dedup.ROWS, "part")
    return [tuple(r.values()) for b in blocks for r in dedup._digest((), b, verdicts.get(id_of(b), nothing(dedup.ROWS))).to_pylist()]


class FirstTask:
    @staticmethod
    def get():
        return FirstTask

    @staticmethod
    def partitionId():  # noqa: N802
        return 0


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize(("stretch", "unit", "block", "wide"), [(1 << 19, 250_000, 4 << 20, 2000), (64, 40, 700, 2000), (64, 1, 300, 3), (97, 10, 1, 1)])
def test_repeats_by_steps(monkeypatch, weak, stretch, unit, block, wide):
    """Units, blocks and groups of any size give what brute force gives, also where nearly all hashes are equal."""
    monkeypatch.setattr(suffix_dedup, "TaskContext", FirstTask)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "UNIT_ANCHORS", unit)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    if weak:
        monkeypatch.setattr(suffix_dedup, "mixed", lambda x, word: (x ^ word) & np.uint64(3))
    rows = odd_repeats()
    assert Counter(suffix_steps(rows, wide=wide)) == Counter(brute_repeats([(d, (t or "").encode()) for d, t in rows]))


def test_colliding_surroundings():
    """Records whose hashes are equal are told apart by their bytes; what shares a suffix only is cut, not the whole."""
    mixed = suffix_dedup.mixed
    a = np.frombuffer(b"0123456789abcdef" + b"x" * 72, "<u8").copy()
    b = a.copy()
    b[0] ^= np.uint64(0x0101)
    zero = np.zeros(1, np.uint64)
    b[1] = a[1] ^ (mixed(zero, a[:1]) ^ mixed(zero, b[:1]))[0]  # two neighbouring words cancel
    records = np.array([a, b, a, b]).view(np.uint8)
    assert (a != b).sum() == 2 and suffix_dedup.equal_rows(records).tolist() in ([0, 1, 0, 1], [1, 0, 1, 0])


def test_long_repeats(spark):
    """Texts of several megabytes, one of them beyond a block, with shared stretches at odd places."""
    rng = np.random.default_rng(6)
    first = rng.integers(97, 123, 5_000_000, np.uint8).tobytes()
    other = rng.integers(97, 123, 2_000_000, np.uint8).tobytes()
    second = other[:700_001] + first[4_300_000:4_300_049] + other[700_001:1_000_000] + first[524_250:1_200_007] + other[1_000_000:] + first[-50:]
    run = "z" * 300_000
    made = spark.createDataFrame([(2, second.decode()), (1, first.decode()), (3, run), (4, run + "y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(made).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 1_200_007 - 524_250 + 50, 0, 300_000]
    assert got[2]["n_spans"] == 2 and got[2]["kept_sha256"] == hashlib.sha256(other[:700_001] + first[4_300_000:4_300_049] + other[700_001:]).hexdigest()


def test_repeats_taken_out(small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        kept = without_repeats(docs)
        assert kept.columns == docs.columns
        source = docs.collect()
        expected = brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in source])
        assert kept.count() == sum(n > cut or n == 0 for _, n, cut, *_ in expected)
        for r in kept.collect():
            if r["text"] is not None and r["n_chars"]:
                assert r["n_chars"] == len(r["text"])


def brute_leaks(docs, items):
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = {}
    prepared = [(i, words(t)) for i, t in items if i is not None]
    for d, t in docs:
        text = words(t)
        for i, item in prepared:
            k = min(5, len(item))
            shingles = lambda w: [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]  # noqa: B023, E731
            s, own = shingles(text) if k else [], shingles(item) if k else []
            if not own or not set(s) & set(own):
                continue
            counts, m = Counter(own), len(own)
            for a in range(max(1, len(s) - m + 1)):
                window = Counter(s[a : a + m])
                shared = sum((window & counts).values())
                score = shared / (sum(window.values()) + m - shared)
                if score >= 0.8:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_leaks(spark, small_docs, edge_docs, no_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r["text"] for r in items.orderBy("item_id").collect()]
    rng = random.Random(3)
    made = []
    for i, t in enumerate(texts[:30]):
        words = t.split()
        if i % 3 == 1:  # a word replaced
            words[rng.randint(5, len(words) - 5)] = "replaced"
        if i % 3 == 2:  # a word put in
            words.insert(rng.randint(0, len(words)), "inserted")
        made.append((1000 + i, "before it " * (i % 4) + " ".join(words).upper() + " and after it" * (i % 5)))
    docs = small_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_leaks(source, [(r["item_id"], r["text"]) for r in items.collect()])
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(docs, items).collect()}
    assert len(expected) >= 15 and found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert {r["doc_id"] for r in without_leaks(docs, items).collect()} == {d for d, _ in source} - {d for d, _ in expected}
    odd = items.select("item_id", "text").union(spark.createDataFrame([(None, "x " * 9), (900, None), (901, ""), (902, "too short")], "item_id long, text string"))
    assert find_leaks(edge_docs, odd).count() == len(brute_leaks([(r["doc_id"], r["text"]) for r in edge_docs.collect()], [(r["item_id"], r["text"]) for r in odd.collect()]))
    assert without_leaks(edge_docs, odd).columns == edge_docs.columns
    assert find_leaks(no_docs, items).count() == 0 and find_leaks(small_docs, items.filter("false")).count() == 0


def mixed_copies(seed, lengths, rates):
    """Texts with copies of many degrees of similarity, below and above 0.8."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts = []
    for n in lengths:
        words = [rng.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(words))
        for rate in rates:
            copy = list(words)
            for at in rng.sample(range(n), max(1, round(n * rate))):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_near_copies_are_exact(spark):
    """Components of similarity 0.8 or more over sets of shingles: clean texts below it stay."""
    texts = mixed_copies(11, [150, 220, 300, 380] * 6, [0.018, 0.022, 0.03, 0.04, 0.05])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [words_shingles(t) for t in texts]
    expected = brute_labels(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    fps = np.frombuffer(b"".join(long_fingerprint(t) for t in texts), "<u8").reshape(-1, WORDS)
    assert sum(distance(fps[i], fps[j]) <= limits()[-1] and expected[i] != expected[j] for i, j in combinations(range(len(texts)), 2)) > 10
    for most in (500_000, 20):  # wide groups are dealt by second codewords too
        assert {r["doc_id"]: r["component_id"] for r in near_copies(docs, most=most).collect()} == dict(enumerate(expected))


def test_many_equal_texts(spark):
    """More exact copies than a key may have before it's split, and near copies of them."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(5, 1600)] + [(4, text + " end"), (3, "nothing like it"), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    assert got == {i: 4 if 4 <= i < 1600 else 3 if i == 3 else 2000 for i, _ in rows}
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == [3, 4, 2000]
    exact = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert {exact[i] for i in range(5, 1600)} <= {4, 5} and exact[2001] == exact[2000]


def test_one_document_stays(spark):
    """Null ids, repeated ids and repeated rows: one row of each group of near copies, with all columns whatever their names."""
    text = " ".join(f"w{i}" for i in range(300))
    near, other = text + " more", " ".join(f"v{i}" for i in range(300))
    rows = [(None, text, 1, "a"), (None, text, 2, "b"), (9, near, 3, "c"), (4, text, 4, "d"), (4, other, 5, "e"), (4, text, 6, "f"), (None, "nothing like it at all", 7, "g"), (None, "nothing like it at all", 8, "h"), (3, None, 9, "i"), (2, "", 10, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, row string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(4, text), (4, other), (0, "nothing like it at all"), (2, "")])


def test_candidates_at_the_limit():
    """Pairs at a similarity of exactly 0.8 meet in a group and are candidates; repeats of a shingle don't count."""
    rng = np.random.default_rng(17)
    for shared, own in ((8, 1), (200, 25)):
        lost = 0
        for _ in range(400):
            h = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            fps = np.frombuffer(fingerprint_of(h[: shared + own]) + fingerprint_of(np.r_[h[:shared], h[shared + own :]]), "<u8").reshape(2, WORDS)
            cut = segments(fps.view(np.uint8).reshape(2, -1))
            lost += not any(len(group_links(i << 28, fps, np.full(2, shared + own))[0]) for i in range(PAIRS) if len(set.intersection(*(set(codewords(c[2 * i : 2 * i + 1])[1].tolist()) for c in cut))))
        assert lost == 0
    words, line = [f"w{i}" for i in range(200)], " ".join(f"l{i}" for i in range(20))
    once, often = (" ".join([*words, *[line] * n]) for n in (1, 8))
    a, b = (np.frombuffer(long_fingerprint(t), "<u8") for t in (once, often))
    assert len(words_shingles(once) & words_shingles(often)) > 0.9 * len(words_shingles(once) | words_shingles(often)) and distance(a, b) < 106


def test_reordered_leaks(spark):
    """Items whose blocks are moved are found at their best window, as by trying every start."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items, docs = [], []
    for i, n in enumerate([40, 60, 60, 120, 150]):
        words = [word() for _ in range(n)]
        items.append((i, " ".join(words)))
        cut = n // (2 + i % 2)
        docs.append((i, " ".join([*[word() for _ in range(200)], *words[cut:], *words[:cut], *[word() for _ in range(200)]])))
        docs.append((100 + i, " ".join([*words[cut:], *[word() for _ in range(n)], *words[:cut]])))  # torn apart: no window holds it
        docs.append((200 + i, " ".join([*words[cut:], *words[:cut]])))
    expected = brute_leaks(docs, items)
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(*made).collect()}
    assert {(1, 1), (3, 3)} <= expected.keys() and found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_odd_items(spark):
    """Short items, items of repeated words, interleaved and repeated passages, and items that share an id."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long_, chorus = [word() for _ in range(40)], [word() for _ in range(9)] * 4
    items = [(1, "single"), (2, "two words"), (3, "one two three four"), (4, " ".join(long_)), (5, " ".join(chorus)), (6, "again " * 30), (7, " ".join(long_[:20])), (7, " ".join(chorus[:15])), (8, " , ")]
    filler = lambda n: [word() for _ in range(n)]
    docs = [
        (1, "a single one"), (2, "two or words, two  WORDS"), (3, "one two three, four"), (4, "one two three"), (5, " ".join([*filler(30), *chorus, *filler(30)])), (6, " ".join([*filler(9), *chorus[4:], *chorus[:4], *filler(9)])),
        (7, "again " * 28), (8, "again " * 60), (9, " ".join([*long_[:20], *long_[:20], *long_[20:]])), (10, " ".join(x for pair in zip(long_, filler(40)) for x in pair)), (11, " ".join([*filler(50), *long_[30:], *long_[:30], *filler(50)])),
        (12, " ".join(long_[3:38])), (13, None), (14, ""), (14, " ".join(long_)),
    ]
    expected = brute_leaks(docs, items)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found) and {(1, 1), (2, 2), (3, 3), (5, 5), (7, 6), (14, 4)} <= found.keys()


def test_radius():
    """Of 10,000 pairs of a window and an item at similarities from 0.8 on, the radius loses next to none."""
    rng = np.random.default_rng(5)
    lost = 0
    for i in range(10_000):
        shared = (8, 12, 40, 96)[i % 4]
        own = shared // 8  # shared / (shared + 2 * own) is 0.8
        h = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        common, n = bits[:shared].sum(0), shared + own
        a, b = 2 * (common + bits[shared:n].sum(0)) > n, 2 * (common + bits[n:].sum(0)) > n
        lost += (a != b).sum() > RADIUS
    assert lost <= 3


def test_large_fingerprint(spark):
    """More shingles than a lane of 16 bits can count, with the same fingerprint as by hand."""
    rng = np.random.default_rng(9)
    for n in (70_000, 1000):
        h = rng.integers(-(2**63), 2**63, n) | 0x10001
        bits = np.unpackbits(h.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
        expected = int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)
        assert with_fingerprint(spark.createDataFrame([(h.tolist(),)], "h array<long>"), "h", "fp").first()["fp"] == expected


def test_limits():
    """Sets of exactly 0.8 stay far within the greatest distance of a candidate, at any size."""
    rng = np.random.default_rng(4)
    most = limits()
    assert (np.diff(most) <= 0).all() and 130 < most[-1] < 145
    for shared, own in ((4, 0), (8, 1), (9, 1), (16, 2), (40, 5), (96, 12), (400, 50)):
        distances = []
        for _ in range(300):
            h = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            fps = np.frombuffer(fingerprint_of(h[: shared + own]) + fingerprint_of(np.r_[h[:shared], h[shared + own :]]), "<u8").reshape(2, WORDS)
            assert near(fps, np.full(2, shared + own), np.array([0]), np.array([1]))[0]
            distances.append(int(distance(fps[0], fps[1])))
        assert max(distances) + 10 < most[min(shared + own, len(most) - 1)]


def test_second_round(spark):
    """Every two members of different labels meet once, in blocks of any size, and only links that join components come out."""
    rng = np.random.default_rng(8)
    rows = [(int(c), int(c * 100 + rng.integers(0, 1 + c * 2)), v, int(rng.integers(1, 30))) for v, c in enumerate(rng.integers(1, 5, 120))]
    members = spark.createDataFrame(rows, "coarse long, label long, vertex long, size long")
    expected = Counter((a[2], b[2]) for a, b in combinations(sorted(rows, key=lambda r: r[2]), 2) if a[0] == b[0] and a[1] != b[1])
    for most in (100, 700, 10**6):
        met = Counter()
        units = {}
        for r in in_blocks(members, most).collect():
            units.setdefault((r["coarse"], r["low"], r["high"]), []).append(r)
        for (_, low, high), unit in units.items():
            two = low != high
            for a, b in combinations(sorted(unit, key=lambda r: r["vertex"]), 2):
                if a["label"] != b["label"] and (a["side"] != b["side"] or not two):
                    met[a["vertex"], b["vertex"]] += 1
        assert met == expected and (most > 1000) == (max(r[2] for r in units) == 1)
    base = rng.integers(0, 2**62, 100)
    sets = [np.unique(np.r_[base[:k], rng.integers(0, 2**62, 100 - k)]) for k in (100, 95, 93, 60, 92, 100)]
    fps = np.frombuffer(b"".join(fingerprint_of(x.view(np.uint64)) for x in sets), "<u8").reshape(-1, WORDS)
    sizes = np.array([*map(len, sets)])
    labels = brute_labels(6, lambda i, j: len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}))
    a, b = joined(np.arange(6), np.zeros(6), False, sizes, fps, np.concatenate(sets))
    assert brute_labels(6, lambda i, j: (i, j) in zip(a.tolist(), b.tolist())) == labels and len(a) == 6 - len(set(labels))
    assert len(joined(np.arange(6), np.array([0, 0, 0, 0, 0, 1]), True, sizes, fps, np.concatenate(sets))[0]) == 4 and not len(joined(np.zeros(6), np.zeros(6), False, sizes, fps, np.concatenate(sets))[0])
