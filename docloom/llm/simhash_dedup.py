"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments. With two differing bits in all there is always a
cyclic pair of neighbouring segments of which the first is equal and the second differs in one bit at
most. The second is decoded with the perfect [23,12,7] Golay code: a word shares the index of its
nearest codeword with one of the one to six codewords within distance four of any word one bit away.
So (equal segment, codeword index) keys bring all linked fingerprints together, where the full
distance is checked. Groups are read as a sorted stream: small ones pair by pair, larger ones by
words one bit away from a fingerprint (two fingerprints are within two bits if they share such a
word), and beyond that by a shuffle on those words. Nothing is dropped and no group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, key_and_text, spread_join, text_groups
from docloom.llm.components import connected_components

#: The Golay generator polynomial, the segments (lowest bit, bits), the seed of the hash.
GENERATOR = 0xC75
SEGMENTS = ((42, 22), (21, 21), (0, 21))
SEED = 42
SHINGLE, RADIUS = 3, 2
#: Up to so many fingerprints of a key are compared pair by pair, and up to so many linked inside a task.
PAIRED, IN_TASK = 64, 50_000
GROUP_BYTES, BLOCK = 4_000_000, 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles of the whole text (ASCII lower case), 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        a, b = starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, map(slice, a, b)), repeat(SEED)), np.uint64, len(a))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, GROUP_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    return key_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - 11, rest)
    return rest


@lru_cache(maxsize=1)
def half_remainders() -> tuple[np.ndarray, np.ndarray]:
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)


def syndrome(words: np.ndarray) -> np.ndarray:
    """remainder() by its halves: the code is linear."""
    low, high = half_remainders()
    return low[words & 0xFFF] ^ high[words >> 12]


@lru_cache(maxsize=1)
def nearby_errors() -> np.ndarray:
    """Per syndrome the errors of weight four at the most: first the coset leader, then up to five more; -1 where there are fewer."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for s, e in zip(syndrome(errors).tolist(), errors.tolist()):
            table[s, used[s]] = e
            used[s] += 1
    return table


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: for each cyclic pair of segments the equal one with every nearby codeword index of the other."""
    table, words = nearby_errors(), fps.astype(np.uint64)
    parts = [(words >> np.uint64(low)).astype(np.int64) & (1 << bits) - 1 for low, bits in SEGMENTS]
    keys, owners = [], []
    for i, exact in enumerate(parts):
        fuzzy = parts[(i + 1) % len(parts)]
        errors = table[syndrome(fuzzy)]
        index = (fuzzy[:, None] ^ errors) >> 11
        there = errors >= 0
        keys.append((i << 40 | exact[:, None] << 12 | index)[there])
        owners.append(np.broadcast_to(fps[:, None], errors.shape)[there])
    return np.concatenate(keys), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges (a, b) with one edge (vertex, root) per vertex that isn't a root."""
    if not len(a):
        return a, b
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertices))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(vertices))
    return vertices[moved], vertices[label[moved]]


def link_by_midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within two bits among distinct fingerprints: those that share a word at most one bit away."""
    masks = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    balls = (fps.view(np.uint64)[:, None] ^ masks).ravel()
    order = np.argsort(balls, kind="stable")
    balls, owner = balls[order], np.repeat(fps, len(masks))[order]
    same = np.flatnonzero(balls[1:] == balls[:-1])
    return forest(owner[same], owner[same + 1])


def _link_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) rows sorted by key -> edges (a, b), and (fp, null) for members of groups too large for a task."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    hot_key = None
    kept_key, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], ["a", "b"])

    def groups(keys: np.ndarray, fps: np.ndarray) -> None:
        nonlocal held
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
            edges.append(link_by_midpoints(np.unique(fps[s : s + n])))
        few = np.repeat((sizes <= PAIRED) & (sizes > 1), sizes)
        keys, fps = keys[few], fps[few]
        for shift in range(1, int(sizes[sizes <= PAIRED].max(initial=1))):
            near = (keys[shift:] == keys[:-shift]) & (np.bitwise_count((fps[shift:] ^ fps[:-shift]).view(np.uint64)) <= RADIUS)
            edges.append((fps[:-shift][near], fps[shift:][near]))
        held = sum(len(x) for x, _ in edges)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if hot_key is not None:
            hot = keys == hot_key
            if hot.any():
                yield rows(fps[hot], None)
            keys, fps = keys[~hot], fps[~hot]
            if len(keys):
                hot_key = None
        if not len(keys):
            continue
        keys, fps = np.r_[kept_key, keys], np.r_[kept, fps]
        last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
        groups(keys[:last], fps[:last])
        kept_key, kept = keys[last:], fps[last:]
        if len(kept) > IN_TASK:
            yield rows(kept, None)
            hot_key, kept_key, kept = int(kept_key[0]), kept_key[:0], kept[:0]
        if held > 500_000:
            a, b = forest(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges]))
            edges, held = [], 0
            yield rows(a, b)
    groups(kept_key, kept)
    if edges:
        yield rows(*forest(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges])))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, owners = golay_keys(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "fp"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of 'at most two differing bits' over a column fp of distinct fingerprints."""
    keys = distinct.select("fp").mapInArrow(_key_rows, "key long, fp long")
    found = checkpoint(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link_stream, "a long, b long"))
    edges = found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    balls = hot.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(64)))).alias("word"))
    stars = balls.withColumn("v", F.min("fp").over(Window.partitionBy("word"))).filter("fp <> v")  # at most 65 rows a word
    return edges.union(stars.select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that can be reached) per row.

    A null or empty text has the zero fingerprint and is linked like any other. Rows that repeat a
    doc_id are separate rows; null ids stay null and don't count for the least id. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct)).select(F.col("vertex").alias("fp"), "root")
    placed = checkpoint(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(placed, least, "root").select("fp", "component_id")
    return spread_join(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
