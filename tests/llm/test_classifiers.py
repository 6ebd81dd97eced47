"""Document statistics by brute force, constraints of the trees, held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import boosted_trees, text_stats
from docloom.llm.labelled import label_sample, sample_stats
from docloom.llm.language_id import BUCKETS, bucket_counts, fit_language, identify_documents, train_ftrl
from docloom.llm.quality_classifier import RATIOS, fit_quality, score_documents
from docloom.llm.quality_rules import fit_rules, judge_documents, keep_documents
from docloom.llm.text_stats import BASE, EXTRA, FEATURES, all_stats, ratios

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        for r in docs.select("text").collect():
            assert all_stats(r["text"] or "")[:5] == brute_stats(r["text"] or "")


def odd_long_texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["é", "#*|", "日本", "a\u2028b", "x\x85y", "\xa0"]
    joiners = [" ", "\n", "\n\n", " \t", "\r\n", "\x0b", "  \n"]
    pick = lambda n: "".join(str(rng.choice(words)) + str(rng.choice(joiners)) for _ in range(n))
    return ["", "one", "\n", "a a a", "x\n" * 400, "x y\nx y\nx z", pick(900), pick(900) * 3, "the same three " * 500, pick(4)]


def test_long_statistics(monkeypatch):
    """Long texts, read in blocks, have the statistics of texts read at once."""
    at_once = [all_stats(t) for t in odd_long_texts()]
    monkeypatch.setattr(text_stats, "LONG_BYTES", 0)
    monkeypatch.setattr(text_stats, "BLOCK_WORDS", 7)
    for t, expected in zip(odd_long_texts(), at_once):
        assert all_stats(t) == expected and expected[:5] == brute_stats(t)


def walked(model, row):
    """The margin of one row, node by node."""
    out = model.base
    for feature, threshold, value in zip(model.feature.tolist(), model.threshold.tolist(), model.value.tolist()):
        node = 0
        while node < len(feature):
            node = 2 * node + 2 if row[feature[node]] > threshold[node] else 2 * node + 1
        out += value[node - len(feature)]
    return out


def test_rules_by_walking(spark, small_docs, edge_docs):
    """Verdicts and scores of every document against trees walked node by node over statistics taken by brute force."""
    model = fit_rules(small_docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert np.isfinite(model.threshold).any()
    for docs in (small_docs, edge_docs):
        expected = Counter()
        for r in docs.collect():
            stats = all_stats(r["text"] or "")
            p = 1 / (1 + math.exp(-max(-40, min(40, walked(model, ratios(np.array([stats]))[0].tolist())))))
            n, *_, repeats = brute_stats(r["text"] or "")
            expected[r["doc_id"], round(p, 9), n >= 50 and 100 * repeats <= 50 * n and p >= 0.5] += 1
        assert Counter((r["doc_id"], round(r["score"], 9), r["kept"]) for r in judge_documents(docs, model).collect()) == expected
    assert len(FEATURES) == ratios(np.array([all_stats("a b")])).shape[1]


def test_base_rules(small_docs, edge_docs, no_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_rules(small_docs, labels)
    for docs in (small_docs, edge_docs):
        texts = [r["text"] or "" for r in docs.collect()]
        got = judge_documents(docs, model).collect()
        assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(map(brute_stats, texts))
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)
        kept = keep_documents(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert judge_documents(no_docs, model).count() == 0
    untaught = fit_rules(no_docs, labels.filter("false"))
    assert all(r["kept"] == (not r["base_failed"]) for r in judge_documents(small_docs, untaught).collect())


def test_rules_separate(tables):
    docs, labels = tables
    found = judge_documents(docs, fit_rules(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    bad, good = found[found.quality == 0], found[(found.quality == 1) & ~found.base_failed]
    assert bad.kept.mean() < 0.02 and good.kept.mean() > 0.98


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 0]) + rng.normal(0, 0.3, 3000)) < 0.6).astype(float)
    model = boosted_trees.fit(x, y, [-1, 0, 1])
    grid = np.linspace(0, 1, 200)
    for row in rng.random((20, 3)):
        for f, sign in ((0, -1), (2, 1)):
            probe = np.repeat(row[None], 200, 0)
            probe[:, f] = grid
            assert (sign * np.diff(model.margin(probe)) >= -1e-9).all()
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8


def test_quality_held_out(tables, edge_docs, no_docs):
    docs, labels = tables
    model = fit_quality(docs, labels)
    found = score_documents(docs, model).toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    held = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.98
    edge = score_documents(edge_docs, model).toPandas()
    assert len(edge) == edge_docs.count() and edge.score.between(0, 1).all()
    assert score_documents(no_docs, model).count() == 0
    untaught = score_documents(edge_docs, fit_quality(no_docs, labels)).toPandas()
    assert (untaught.score == 0.5).all()


def test_language_held_out(tables, edge_docs, no_docs):
    docs, _ = tables
    model = fit_language(docs)
    found = identify_documents(docs, model).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99 and held.score.between(0, 1).all()
    edge = identify_documents(edge_docs, model).toPandas().merge(edge_docs.select("doc_id", "text").toPandas().drop_duplicates(), on="doc_id")
    letterless = edge[edge.text.isna() | edge.text.fillna("").map(lambda t: not any(c.isalpha() for c in t))]
    assert len(letterless) and (letterless.lang_pred == "und").all()
    assert identify_documents(no_docs, model).count() == 0
    assert set(identify_documents(edge_docs, fit_language(no_docs)).toPandas().lang_pred) == {"und"}


def test_same_model_twice(spark, small_docs):
    a, b = fit_language(small_docs), fit_language(small_docs.repartition(7))
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def brute_buckets(text):
    """Bucket counts with whole numbers of Python, one n-gram at a time."""
    mix, mask, found = 0x9E3779B97F4A7C15, (1 << 64) - 1, Counter()
    text = text.lower()
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            value = n
            for c in text[i : i + n]:
                value = (value ^ ord(c)) * mix & mask
                value ^= value >> 29
            found[(value * mix & mask) >> 50] += 1
    return found


def test_language_by_brute_force(small_docs, edge_docs):
    """Every prediction against a plain sum over n-grams."""
    model = fit_language(small_docs)
    assert BUCKETS == 1 << 14 and len(model.languages) > 1
    for docs in (small_docs, edge_docs):
        expected = Counter()
        for r in docs.collect():
            text = r["text"]
            if not text or not any(c.isalpha() for c in text):
                expected[r["doc_id"], "und", 0.0] += 1
                continue
            values = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in brute_buckets(text).items()}
            norm = math.sqrt(sum(v * v for v in values.values()))
            logits = [(sum(v / norm * float(model.weights[b, k]) for b, v in values.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
            powers = [math.exp(z - max(logits)) for z in logits]
            best = max(range(len(powers)), key=powers.__getitem__)
            expected[r["doc_id"], model.languages[best], round(powers[best] / sum(powers), 6)] += 1
        assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in identify_documents(docs, model).collect()) == expected


def test_ftrl_by_hand():
    """The weights against the update rule written out per coordinate."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append((at, rng.random(4), i % 3))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.6, 0.01
    weights, bias = train_ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = Counter(), Counter()

    def weight(place, k):
        first = 0 if place == "bias" else l1
        if abs(z[place, k]) <= first:
            return 0.0
        return -(z[place, k] - math.copysign(first, z[place, k])) / ((beta + math.sqrt(n[place, k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            features = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            logits = [sum(v * weight(b, k) for b, v in features) for k in range(3)]
            powers = [math.exp(v) for v in logits]
            old = {(b, k): weight(b, k) for b, _ in features for k in range(3)}
            for b, v in features:
                for k in range(3):
                    g = v * (powers[k] / sum(powers) - (k == label))
                    z[b, k] += g - (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / alpha * old[b, k]
                    n[b, k] += g * g
    assert np.allclose([[weight(b, k) for k in range(3)] for b in range(12)], weights[:12]) and np.allclose([weight("bias", k) for k in range(3)], bias)
    assert (weights[:12] == 0).any() and not weights[12:].any()


def test_quality_by_brute_force(spark, small_docs, edge_docs):
    """Every score against densities written out with inverse and determinant, over statistics of every learned document."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_quality(small_docs, labels)
    learned = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    names = BASE + EXTRA
    taught = [(dict(zip(names, all_stats(r["text"] or ""))), learned[r["doc_id"]]) for r in small_docs.collect() if r["doc_id"] in learned]
    better = [s for s, y in taught if y == 1]
    typical = [float(np.median([s[a] / max(s[b], 1) for s in better])) for a, b, _ in RATIOS]
    features = lambda s: [math.sqrt((s[a] + w * t) / (s[b] + w)) for (a, b, w), t in zip(RATIOS, typical)]
    x, y = np.array([features(s) for s, _ in taught]), np.array([y for _, y in taught])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - centre) / scale
    pooled, densities = np.cov(x.T), []
    for k in (0, 1):
        own = x[y == k]
        c = 0.9 * np.cov(own.T) + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.01 * np.eye(len(RATIOS))
        densities.append((own.mean(0), np.linalg.inv(c), math.log((len(own) + 1) / (len(x) + 2)) - 0.5 * math.log(np.linalg.det(c))))
    for docs in (small_docs, edge_docs):
        expected = Counter()
        for r in docs.collect():
            v = (np.array(features(dict(zip(names, all_stats(r["text"] or ""))))) - centre) / scale
            a, b = (o - 0.5 * float((v - m) @ inverse @ (v - m)) for m, inverse, o in densities)
            expected[r["doc_id"], round(1 / (1 + math.exp(-max(-40, min(40, b - a)))), 6)] += 1
        assert Counter((r["doc_id"], round(r["score"], 6)) for r in score_documents(docs, model).collect()) == expected
    sample = sample_stats(small_docs, label_sample(labels, "quality", 20_000))
    assert len(sample[0]) == labels.join(small_docs, "doc_id").count()


def test_buckets_in_pieces(monkeypatch):
    from docloom.llm import language_id

    for text in ("", "a", "abc", "Straße İstanbul 日本語 " * 9):
        monkeypatch.setattr(language_id, "PIECE_CHARS", 1_000_000)
        whole = bucket_counts(text)
        for size in (1, 2, 5):
            monkeypatch.setattr(language_id, "PIECE_CHARS", size)
            assert (bucket_counts(text) == whole).all()
        assert dict(brute_buckets(text)) == {int(b): int(whole[b]) for b in np.flatnonzero(whole)}
