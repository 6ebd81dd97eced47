"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-cased characters are hashed into a fixed number of buckets with numpy.
Document frequencies come from all documents that may be learned from; the weights are trained on a
bounded sample by follow-the-regularised-leader with an elastic-net penalty, and a temperature fitted
on a part of the sample kept aside calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import key_and_text, text_groups
from docloom.llm.labelled import GROUP_BYTES, crc_of_id

#: Hash buckets of the n-grams, the longest n-gram, and documents per language the weights are trained on, at the most.
BUCKETS = 1 << 14
LONGEST = 3
SAMPLE_PER_LANGUAGE = 600
#: A longer text is counted piece by piece.
PIECE_CHARS = 1_000_000
LETTER = regex.compile(r"\p{L}")
#: Fixed value: the multiplier that mixes an n-gram's characters.
MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole lower-cased text."""
    text = text.lower()
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for start in range(0, len(text), PIECE_CHARS):
        codes = np.frombuffer(text[max(0, start - LONGEST + 1) : start + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        before = min(start, LONGEST - 1)
        for n in range(1, LONGEST + 1):
            skip = max(0, before - n + 1)  # n-grams that end in the piece before were counted there
            size = len(codes) - n + 1 - skip
            if size > 0:
                value = np.full(size, n, np.uint64)
                for k in range(n):
                    value = (value ^ codes[skip + k : skip + k + size]) * MIX
                    value ^= value >> np.uint64(29)
                total += np.bincount(((value * MIX) >> shift).astype(np.int64), minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; und and 0 without a letter or without a model."""
        if not self.languages or not LETTER.search(text):
            return "und", 0.0
        counts = bucket_counts(text)
        at = np.flatnonzero(counts)
        x = tf_idf(counts[at], self.idf[at])
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. rows: (buckets, values, class). Per-coordinate FTRL-proximal, L1 and L2 together, no penalty on the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray | slice, first: float) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= first, 0.0, -(za - np.sign(za) * first) / ((beta + np.sqrt(na)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w, b = weights(at, l1), weights(slice(BUCKETS, None), 0.0)
            p = softmax(x @ w + b[0])
            p[label] -= 1
            for place, g, old in ((at, x[:, None] * p, w), (slice(BUCKETS, None), p[None, :], b)):
                square = g * g
                sigma = (np.sqrt(n[place] + square) - np.sqrt(n[place])) / alpha
                z[place] += g - sigma * old
                n[place] += square
    return weights(slice(0, BUCKETS), l1), weights(slice(BUCKETS, None), 0.0)[0]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 0.05 and 5 with the least log loss, 1 without rows."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 5, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: in how many of its documents the bucket occurs; bucket -1 counts documents."""
    frequency, documents = np.zeros(BUCKETS, np.int64), 0
    for _, texts in text_groups(batches, GROUP_BYTES):
        for text in texts:
            frequency += bucket_counts(text) > 0
            documents += 1
    at = np.flatnonzero(frequency)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[documents, frequency[at]])], ["bucket", "n"])


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, done = batch.column(2).to_pylist(), 0
        for keys, texts in text_groups(iter([batch]), GROUP_BYTES):
            vectors = [(np.flatnonzero(c), c[c > 0]) for c in map(bucket_counts, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(langs[done : done + len(keys)]), pa.array([a.astype("<u2").tobytes() for a, _ in vectors]), pa.array([c.astype("<f4").tobytes() for _, c in vectors])],
                ["doc_id", "lang", "buckets", "counts"],
            )
            done += len(keys)


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from text and lang of documents that aren't held out (crc32 of the id modulo 4 is not 2).

    Rows with a null id, text or lang teach nothing. Without any row to learn from the model has no
    language and calls every text und.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.dropna().filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency = np.zeros(BUCKETS + 1)
    counted = known.select("doc_id", "text").mapInArrow(_count_rows, "bucket long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(1_000_000 * per_language / max(per_language, n))))
    rows = known.filter(chosen).mapInArrow(_vector_rows, "doc_id long, lang string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    place = {lang: i for i, lang in enumerate(languages)}
    data = []
    for r in rows:
        at = np.frombuffer(r["buckets"], "<u2").astype(np.int64)
        data.append((at, tf_idf(np.frombuffer(r["counts"], "<f4").astype(float), idf[at]) if len(at) else np.zeros(0), place[r["lang"]]))
    aside, learn = data[::5], [d for i, d in enumerate(data) if i % 5]
    weights, bias = train_ftrl(learn or aside, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in aside]).reshape(len(aside), -1)
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, np.array([c for *_, c in aside], np.int64)))


def identify_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    A null text or one without a letter is und with score 0. A null doc_id stays null and isn't held
    out; repeated rows get equal results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, GROUP_BYTES):
            found = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x for x, _ in found]), pa.array([s for _, s in found])], ["doc_id", "lang_pred", "score"])

    found = key_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
