"""Near copies by long SimHash fingerprints and Golay keys: for links far beyond two bits.

Texts that share four fifths of their five-word shingles differ in about 15 % of SimHash bits, too many
for one short fingerprint. So WORDS x 64 bits are taken from the distinct shingles and cut into
23-bit segments; each of PAIRS first segments is paired with SECONDS others. Two words at most two bits apart always share one of their one to six nearby Golay codewords, and
often so when they are further apart; a pair of documents meets if both segments of any pair do. Met
pairs whose sets have sizes that allow SIMILARITY, and that differ in no more bits than such sets of their size do, are candidates only: the distinct shingle hashes of both texts are fetched
and a pair links if it shares SIMILARITY of them, counted exactly.

Documents are dealt by the codeword of a pair's first segment, with the whole fingerprint; the second
segment's codewords are made where they are needed. Groups arrive as a sorted stream. A first segment's
codeword that more than a given number of documents have isn't one group: its members are dealt by the second segments'
codewords too. The first round
verifies a spanning forest of each group's candidates, so a large cluster costs little more than its
size. Where that leaves what candidates hold together in several components, a second round brings the sets of these documents
together, in blocks of bounded size, and verifies every candidate pair between different components. Only pairs that join two of them leave a task.

Documents with the same set of shingles are one vertex, named by 128 bits of a hash of the set and
numbered afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, drop_rows, key_and_text, spread_join, text_groups, text_row
from docloom.llm.components import connected_components
from docloom.llm.simhash_dedup import BLOCK, GROUP_BYTES, SEED, forest, nearby_errors, syndrome

#: Words of a fingerprint, bits of a segment, first segments, second segments of each. A similarity of 0.8 differs in 87
#: of 576 bits on average (deviation 9), one of 0.7 in 111; unrelated texts differ in 288 (deviation 12).
WORDS, SEGMENT = 9, 23
PAIRS = WORDS * 64 // SEGMENT // 2
SECONDS = 6
#: A candidate differs by so many deviations at the most from the distance of equally large sets of exactly SIMILARITY (which decides, of the sets of shingles, as a fraction).
DEVIATIONS = 6
SHINGLE = 5
SIMILARITY = (4, 5)
#: Members of a group that a task holds, at the most, before the group is dealt by second codewords.
IN_TASK = 500_000
#: Bytes of sets in a block of the second round.
SETS_BYTES = 16_000_000
#: Groups up to this size are compared pair by pair in one go.
SMALL = 32
BYTES = WORDS * 8


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of the whole text (ASCII lower case), in order, with repeats; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    out = []
    for at in range(0, len(starts), BLOCK):
        a, b = starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, map(slice, a, b)), repeat(SEED)), np.uint64, len(a)))
    return np.concatenate(out)


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """Majority bits of WORDS hashes of each distinct shingle hash; zero without shingles."""
    ones = np.zeros(WORDS * 64, np.int64)
    spread = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in range(0, len(hashes), 4096):
        x = hashes[part : part + 4096, None] + spread
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), BYTES), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def long_fingerprint(text: str, shingle: int = SHINGLE) -> bytes:
    return fingerprint_of(np.unique(shingle_hashes(text, shingle)))


def set_name(hashes: np.ndarray) -> bytes:
    """The name of a set of shingles, sorted and distinct."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def bit_words(fps: np.ndarray) -> np.ndarray:
    """Rows of fingerprint bytes as rows of 64-bit words, the first bit first."""
    return np.ascontiguousarray(fps).view(np.uint8).reshape(-1, BYTES).view(">u8").astype(np.uint64)


def segment(words: np.ndarray, j: int) -> np.ndarray:
    """The values of segment j, from rows of bit_words()."""
    at, skip = divmod(j * SEGMENT, 64)
    left = words[:, at] << np.uint64(skip) >> np.uint64(64 - SEGMENT)
    over = skip + SEGMENT - 64
    return (left | words[:, at + 1] >> np.uint64(64 - over) if over > 0 else left).astype(np.int64)


def segments(fps: np.ndarray) -> np.ndarray:
    """Rows of fingerprint bytes -> rows of segment values."""
    words = bit_words(fps)
    return np.stack([segment(words, j) for j in range(2 * PAIRS)], axis=1)


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and index of every nearby codeword of the words."""
    errors = nearby_errors()[syndrome(words)]
    there = errors >= 0
    return np.nonzero(there)[0], ((words[:, None] ^ errors) >> 11)[there]


def group_key(part: np.ndarray, k: int = -1, second: np.ndarray | int = 0) -> np.ndarray:
    """The key of a group: the first segment with its codeword, and for wide groups the number of the second one with its codeword."""
    return part << 16 | (k + 1) << 12 | second


def second_of(part: int, k: int) -> int:
    """The segment that is paired k-th with the first segment of a part."""
    return 2 * (((part >> 12) + k) % PAIRS) + 1


def _deal(wide: frozenset[int] = frozenset()):
    """Rows (fp, ...) -> one row per group: first segments with every nearby codeword, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                words = bit_words(np.frombuffer(b"".join(piece.column(0).to_pylist()), np.uint8))
                keys, owners = [], []
                for i in range(PAIRS):
                    owner, index = codewords(segment(words, 2 * i))
                    part = i << 12 | index
                    split_up = np.isin(part, [*wide])
                    keys.append(group_key(part[~split_up]))
                    owners.append(owner[~split_up])
                    for k in range(SECONDS if split_up.any() else 0):
                        at, second = codewords(segment(words[owner[split_up]], second_of(i << 12, k)))
                        keys.append(group_key(part[split_up][at], k, second))
                        owners.append(owner[split_up][at])
                at = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(c.take(at) for c in piece.columns)], ["key", *piece.schema.names])

    return run


def seconds(key: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per second segment of a group's first one: members (rows of 64-bit words) and nearby codewords, in the order of the codewords."""
    if key >> 12 & 15:  # a part of a wide group: all members have the codeword
        yield np.arange(len(fps)), np.zeros(len(fps), np.int64)
        return
    words = bit_words(fps)
    for k in range(SECONDS):
        owner, index = codewords(segment(words, second_of(key >> 16, k)))
        order = np.argsort(index, kind="stable")
        yield owner[order], index[order]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


@lru_cache(maxsize=1)
def limits() -> np.ndarray:
    """The greatest distance of candidates by the size of the smaller set (the last one for all larger ones).

    A bit of two sets of n shingles that share SIMILARITY is a majority of n fair bits, shared ones in common: the chance that it differs is summed over their numbers.
    """
    top, bottom = SIMILARITY
    binomial = lambda n: np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n
    out = [0]
    for n in range(1, 128):
        shared = min(n, -(-2 * n * top // (top + bottom)))  # of the union 2 * n - shared
        own = binomial(n - shared)
        ones = np.array([own[2 * (k + np.arange(len(own))) > n].sum() for k in range(shared + 1)])
        p = float((binomial(shared) * 2 * ones * (1 - ones)).sum())
        mean = WORDS * 64 * p
        out.append(int(mean + DEVIATIONS * (mean * (1 - p)) ** 0.5) + 1)
    top_ones = 2 * top / (top + bottom)
    p = float(np.arccos(top_ones) / np.pi)
    mean = WORDS * 64 * p
    out.append(int(mean + DEVIATIONS * (mean * (1 - p)) ** 0.5) + 1)
    return np.maximum.accumulate(np.array(out)[::-1])[::-1]


def near(fps: np.ndarray, sizes: np.ndarray, a, b) -> np.ndarray:
    """Whether members a and b are candidates: sets whose sizes allow SIMILARITY, with a distance that such sets have."""
    top, bottom = SIMILARITY
    least = np.minimum(sizes[a], sizes[b])
    out = least * bottom >= np.maximum(sizes[a], sizes[b]) * top
    at = np.flatnonzero(out)
    most = limits()
    pick = lambda x: x if np.ndim(x) == 0 else x[at]
    out[at] = distance(fps[pick(a)], fps[pick(b)]) <= most[np.minimum(least[at], len(most) - 1)]
    return out


def linked(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a group's candidates: what a component has reached isn't compared again."""
    rest, out = np.arange(len(fps)), ([], [])
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            hit = near(fps, sizes, u, rest)
            found, rest = rest[hit], rest[~hit]
            out[0].extend([u] * len(found))
            out[1].extend(found.tolist())
            frontier.extend(found.tolist())
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def group_links(key: int, fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among the members (rows of 64-bit words) of a group, by the codewords of the second segments: a forest of them."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for owner, index in seconds(key, fps):
        starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        counts = np.diff(np.r_[starts, len(index)])
        for s, n in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist()):
            members = owner[s : s + n]
            a, b = linked(fps[members], sizes[members])
            found.append((members[a], members[b]))
        few = np.repeat((counts > 1) & (counts <= SMALL), counts)
        owner, index = owner[few], index[few]
        for shift in range(1, int(counts[counts <= SMALL].max(initial=1))):
            same = np.flatnonzero(index[shift:] == index[:-shift])
            same = same[near(fps, sizes, owner[same], owner[same + shift])]
            found.append((owner[same], owner[same + shift]))
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64),) * 2


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(key, fp, ...) rows sorted by key -> key, fingerprints and the other columns of each group of two members or more."""
    held: list[list[np.ndarray]] = []
    key = None

    def group() -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        fps, *others = (np.concatenate(c) for c in zip(*held))
        if len(fps) > 1:
            yield key, fps, others

    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        columns = [np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS), *(c.to_numpy() for c in batch.columns[2:])]
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(keys)]):
            if held and keys[s] != key:
                yield from group()
                held.clear()
            key = int(keys[s])
            held.append([c[s:e] for c in columns])
    if held:
        yield from group()


def _edges(vertex: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(vertex[a], pa.int64()), pa.array(vertex[b], pa.int64())], ["u", "v"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, vertex, size) rows sorted by key -> a forest of each group's candidates (u, v)."""
    for key, fps, (vertex, sizes) in _groups(batches):
        yield _edges(vertex, *group_links(key, fps, sizes))


def joined(labels: np.ndarray, sides: np.ndarray, two: bool, sizes: np.ndarray, fps: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join components (labels): every candidate pair with different labels (from different sides, if it takes two) is verified, unless links found before join it.

    sets: the sorted hashes of all members' sets, one after the other.
    """
    _, words = np.unique(sets, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    labels, out = labels.copy(), ([], [])
    mark = np.zeros(int(words.max(initial=-1)) + 1, bool)
    top, bottom = SIMILARITY
    for i in range(len(labels) - 1):
        rest = i + 1 + np.flatnonzero((labels[i + 1 :] != labels[i]) & ((sides[i + 1 :] != sides[i]) | (not two)))
        rest = rest[near(fps, sizes, i, rest)] if len(rest) else rest
        if not len(rest):
            continue
        mark[words[starts[i] : ends[i]]] = True
        shared = np.array([int(mark[words[starts[j] : ends[j]]].sum()) for j in rest.tolist()])
        mark[words[starts[i] : ends[i]]] = False
        for j in rest[bottom * shared >= top * (sizes[i] + sizes[rest] - shared)].tolist():
            if labels[i] != labels[j]:
                out[0].append(i)
                out[1].append(j)
                labels[labels == labels[j]] = labels[i]
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit columns ..., side, vertex, label, size, fp, hashes) rows sorted by unit -> links (u, v) that join components."""
    held: list[pa.RecordBatch] = []
    last = None

    def unit() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        sides, vertex, labels, sizes = (rows.column(c).to_numpy() for c in ("side", "vertex", "label", "size"))
        fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
        return _edges(vertex, *joined(labels, sides, last[1] != last[2], sizes, fps, rows.column("hashes").combine_chunks().flatten().to_numpy()))

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("coarse", "low", "high")], axis=1) if batch.num_rows else np.zeros((0, 3), np.int64)
        bounds = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
        for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(keys)]):
            if held and tuple(keys[s]) != last:
                yield unit()
            last = tuple(keys[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield unit()


def in_blocks(members: DataFrame, most: int) -> DataFrame:
    """members (coarse, label, vertex, size, ...) -> rows of units (coarse, low, high) in which every two members of different labels under one coarse component meet once.

    A block holds about `most` bytes of sets: of one label if it has more than that, else of several. A unit is two blocks that aren't of one label, or a block of several with itself.
    """
    held = members.groupBy("coarse", "label").agg(F.sum(8 * F.col("size") + BYTES).alias("bytes"))
    large = F.col("bytes") > most
    blocks = held.groupBy("coarse").agg(
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("bytes"))), F.lit(0)) / most).cast("int").alias("mixed"),
        F.array_sort(F.collect_list(F.when(large, F.struct("label", F.ceil(F.col("bytes") / most).cast("int").alias("n"))))).alias("large"),
    )
    none = F.lit(None).cast("long")
    several = F.when(F.col("mixed") > 0, F.transform(F.sequence(F.lit(1), F.col("mixed")), lambda i: F.struct(none.alias("label"), i.alias("i")))).otherwise(F.array().cast("array<struct<label:bigint,i:int>>"))
    single = F.flatten(F.transform("large", lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.struct(x["label"].alias("label"), i.alias("i")))))
    blocks = checkpoint(blocks.withColumn("all", F.concat(several, single)).select("coarse", "all"))
    rows = spread_join(members, blocks, "coarse")
    own_label = F.filter("all", lambda x: x["label"] == F.col("label"))
    pick = lambda some: F.get(some, F.pmod(F.xxhash64("vertex"), F.size(some)).cast("int"))
    rows = rows.withColumn("own", F.when(F.size(own_label) > 0, pick(own_label)).otherwise(pick(F.filter("all", lambda x: x["label"].isNull()))))
    rows = rows.withColumn("side", F.array_position("all", F.col("own")).cast("long"))
    partners = F.filter(F.transform("all", lambda x, i: F.struct(x["label"].alias("label"), (i + 1).cast("long").alias("at"))), lambda x: ~x["label"].eqNullSafe(F.col("own.label")) | x["label"].isNull())
    rows = rows.withColumn("partner", F.explode(F.transform(partners, lambda x: x["at"])))
    return rows.withColumn("low", F.least("side", "partner")).withColumn("high", F.greatest("side", "partner")).drop("all", "own", "partner")


def once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()


def met(vertices: DataFrame, link, columns: str, most: int) -> DataFrame:
    """The candidates (u, v) that link() finds in the groups of vertices (fp, vertex, size, ...; columns: their schema). Groups of more than `most` members are dealt by second codewords too."""
    wide: frozenset[int] = frozenset()
    if vertices.count() > most:  # else no group can be that large; there are PAIRS x 4,096 first codewords
        sizes = vertices.select("fp").mapInArrow(_deal(), "key long, fp binary").groupBy("key").count()
        wide = frozenset(r["key"] >> 16 for r in sizes.filter(F.col("count") > most).collect())
    dealt = vertices.mapInArrow(_deal(wide), f"key long, {columns}")
    return once(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "u long, v long"))


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """vertex, hashes (the sorted distinct hashes of its shingles) per row of (vertex, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vertices, part in text_groups(batches, GROUP_BYTES):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in part]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["vertex", "hashes"])

    return texts.mapInArrow(run, "vertex long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v), a checkpoint, whose sets have a similarity of SIMILARITY or more, counted exactly. A vertex of many pairs is split over several tasks."""
    top, bottom = SIMILARITY
    both = spread_join(pairs, sets.select(F.col("vertex").alias("u"), F.col("hashes").alias("a")), "u")
    both = both.join(sets.select(F.col("vertex").alias("v"), F.col("hashes").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(bottom * shared >= top * (F.size("a") + F.size("b") - shared)).select("u", "v")


def vertices_and_roots(docs: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, name) per row of documents, row being a hash of the text; and (vertex, name, first, root) per set of shingles, first being its least (no id, doc_id, row) with the number of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, GROUP_BYTES):
            hashes = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            columns = [[k["doc_id"] for k in keys], [k["row"] for k in keys], [set_name(h) for h in hashes], [fingerprint_of(h) for h in hashes], [len(h) for h in hashes]]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "row", "name", "fp", "size"])

    texts = key_and_text(docs).select("doc_id", text_row(F.col("text")).alias("row"), "text")
    rows = checkpoint(texts.select(F.struct("doc_id", "row"), "text").mapInArrow(run, "doc_id long, row long, name binary, fp binary, size long"))
    repeats = rows.groupBy("name", "doc_id", "row").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("fp", "size")).alias("print"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "rows")).alias("first")
    sets_named = repeats.groupBy("name").agg(first, F.min("print").alias("print")).select(F.monotonically_increasing_id().alias("vertex"), "name", "first", "print.*")
    distinct = checkpoint(sets_named)
    members = distinct.select("fp", "vertex", "size")

    forest_pairs = checkpoint(met(members, _link, "fp binary, vertex long, size long", most))
    coarse = checkpoint(connected_components(forest_pairs).withColumnRenamed("root", "coarse"))
    wanted = distinct.join(coarse.select("vertex"), "vertex").select("vertex", "first.doc_id", "first.row")
    own = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["row"] == wanted["row"])).groupBy("vertex").agg(F.first("text").alias("text"))
    sets = checkpoint(sets_of(own, shingle))
    links = checkpoint(verified(forest_pairs, sets))

    stars = connected_components(links)
    named = checkpoint(coarse.join(stars, "vertex", "left").select("vertex", "coarse", F.coalesce("root", "vertex").alias("label")))
    open_ = named.groupBy("coarse").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("coarse")
    units = in_blocks(checkpoint(members.join(named.join(open_, "coarse", "left_semi"), "vertex")), SETS_BYTES)
    units = units.select("coarse", "low", "high", "side", "vertex", "label", "size", "fp")
    fetched = units.join(sets, "vertex").select(*units.columns, "hashes")
    joining = fetched.repartition("coarse", "low", "high").sortWithinPartitions("coarse", "low", "high").mapInArrow(_join, "u long, v long")
    joining = checkpoint(joining)
    roots = connected_components(stars.select(F.col("vertex").alias("u"), F.col("root").alias("v")).union(joining))
    placed = checkpoint(distinct.join(roots, "vertex", "left").select("vertex", "name", "first", F.coalesce("root", "vertex").alias("root")))
    return rows.select("doc_id", "row", "name"), placed


def near_copies(docs: DataFrame, shingle: int = SHINGLE, most: int = IN_TASK) -> DataFrame:
    """doc_id, component_id (the least doc_id that can be reached by links) per row of documents.

    Texts without words have the empty set of shingles and form one group. Null ids stay null and don't count
    for the least id; rows that repeat a doc_id are separate rows. Other columns are ignored; an empty table gives an empty result.
    """
    rows, placed = vertices_and_roots(docs, shingle, most)
    least = placed.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("component_id"))
    named = spread_join(placed, least, "root").select("name", "component_id")
    return spread_join(rows, named, "name").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = IN_TASK) -> DataFrame:
    """One row of each component: the one with the least doc_id (a null id comes last) and, among different texts under this id, the least text hash.

    Rows that repeat id and text are one document, of which one row stays. All columns are kept, whatever their names; an empty table gives an empty one.
    """
    rows, placed = vertices_and_roots(docs, shingle, most)
    kept = checkpoint(placed.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    gone = rows.select("doc_id", "row").subtract(kept.select("doc_id", "row"))
    return drop_rows(drop_rows(docs, gone), kept.filter("rows > 1").select("doc_id", "row"), but_one=True)
