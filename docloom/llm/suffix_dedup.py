"""Exact removal of byte strings that also start in an earlier document, by blockwise suffix sorting.

Every string of LENGTH bytes is a suffix cut off at that depth. Its bucket is the word of GRAM bytes in it
whose hash is least (its anchor, the first one if it repeats) with the anchor's place in it, so equal strings always share a bucket.
Neighbouring strings mostly have one anchor in common: a record holds an anchor with the bytes of all its strings, one
record for about eighteen positions. Hashes only choose anchors and deal rows; whatever is called equal
has been compared byte by byte. The steps:

1. Blocks: documents are packed into compressed blocks, with all their columns, and written once.
2. Look-up: blocks send 32 bits per anchor; the groups answer with one bit, whether another one has the same.
   A record whose anchor nobody else has needs no more than that.
3. Anchors: per unit (a stretch of a block) equal records form a class. All strings of a record go if its
   document isn't the least of the class; one of the least goes on, with its bytes, to the group of its anchor.
4. Buckets: groups join equal records in the same way. Where an anchor has several, its
   suffix buckets are sorted one at a time. The ranks of a difference cover's samples are computed
   once per group; every suffix meets a sample within three bytes, so a rank and three more bytes order a
   bucket however long its ties are. Suffixes in a run of equals that don't come from its least document go.
5. Removal: each block gets the verdicts on its classes and drops the covered bytes.

Nothing that many documents share is gathered as a whole: units and tasks settle equal records among
their own documents and send one of each. An anchor with more than WIDE records (the edge of a passage
that a large part of the corpus holds) isn't one bucket group: its suffixes go one by one, with their bytes, to
groups by their hash, again after each unit has settled its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, key_and_text, release

LENGTH, GRAM = 50, 16
PLACES = LENGTH - GRAM + 1
LEFT = PLACES - 1
AROUND = LEFT + LENGTH
#: A record: the bytes around an anchor (zero outside its strings), how many of them lie before and from the anchor on, and zeros.
RECORD = AROUND + 4
#: The difference cover {0, 1, 3} modulo 7, in which any two places have a common distance; its greatest gap.
COVER, PERIOD, GAP = (0, 1, 3), 7, 3
SAMPLE = LENGTH - GAP
#: Bytes of input per block, per group of records and per group of the look-up; strings looked at in one go (their places take PLACE_BITS); anchors after which a unit ends.
BLOCK_BYTES, GROUP_BYTES, LOOKUP_BYTES, STRETCH, UNIT_ANCHORS = 4 << 20, 4 << 20, 16 << 20, 1 << 17, 250_000
PLACE_BITS = np.uint64(20)
WIDE = 2000
#: Kinds of rows: classes for their anchor's group, anchors that are wide, single suffixes, verdicts.
GROUPED, MARKED, SUFFIX, VERDICT = range(4)
ONE = np.uint64(1)
WHOLE = np.uint64((1 << PLACES) - 1)
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BEFORE, AFTER = 64, 128

BLOCKS = "block long, ids binary, flags binary, lengths binary, bytes binary, others binary"
#: Bits of a row's flags.
NAMED, TEXTLESS = 1, 2
LOOKUPS = "part long, block long, hashes binary"
ANSWERS = "block long, part long, shared binary"
ROWS = "part long, kind int, blocks binary, classes binary, docs binary, bytes binary, places binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mixed(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (x ^ word) * MIX1
    x ^= x >> np.uint64(29)
    return x


def slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - width + size], x[width - size :]) if size < width else x


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def per_group(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the sum of values over its group."""
    return np.add.reduceat(values, np.flatnonzero(starts))[np.cumsum(starts) - 1] if len(values) else values


def equal_rows(records: np.ndarray) -> np.ndarray:
    """The number of the class of each row (bytes, a multiple of eight): equal rows, and only these, have the same number.

    Rows are brought together by a hash and then compared; if unequal ones have the same hash, all are sorted by their bytes.
    """
    words = np.ascontiguousarray(records).view("<u8")
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = mixed(h, column)
    order = np.argsort(h, kind="stable")
    new = firsts(h[order])
    same = np.flatnonzero(~new)
    if (words[order[same]] != words[order[same - 1]]).any():
        order = np.lexsort(words.T)
        new = firsts(*words[order].T)
    out = np.empty(len(words), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def least_of(classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Per row the least document of its class."""
    if not len(docs):
        return docs
    least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, docs)
    return least[classes]


class Block:
    """The joined texts of a block, and the units of anchors in it, the same ones whenever they are asked for."""

    def __init__(self, lengths: np.ndarray, data: bytes):
        self.ends = np.cumsum(lengths.astype(np.int64))
        self.starts = self.ends - lengths
        self.size = len(data)
        self.padded = bytes(BEFORE) + data + bytes(AFTER)
        self.bytes = np.frombuffer(self.padded, np.uint8)
        self.words = np.ndarray((self.size + BEFORE + AFTER - 8,), "<u8", self.padded, 0, (1,))  # the eight bytes from each place on; place p is at p + BEFORE

    def anchors(self, start: int, end: int) -> tuple[np.ndarray, ...]:
        """For the strings that start in [start, end): places of their anchors, text numbers, hashes, and where the first string of each starts and the last one ends."""
        b = min(self.size, end + LEFT)
        if b - start < PLACES:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        h = mixed(self.words[BEFORE + start : BEFORE + b] * MIX2, self.words[BEFORE + 8 + start : BEFORE + 8 + b])
        h = (h * MIX2) ^ (h >> np.uint64(32))
        least = slide(h >> PLACE_BITS << PLACE_BITS | np.arange(len(h), dtype=np.uint64), PLACES, np.minimum)
        first, last = np.searchsorted(self.ends, [start, b - 1], side="right")
        reach = np.minimum(self.ends[first : last + 1], b) - np.maximum(self.starts[first : last + 1], start)
        owner = np.repeat(np.arange(first, last + 1), reach)[: len(least)]
        at = np.flatnonzero(start + np.arange(len(least)) + LENGTH <= self.ends[owner])
        place = (least[at] & ((ONE << PLACE_BITS) - ONE)).astype(np.int64)
        begins = np.flatnonzero(firsts(place) | firsts(at - np.arange(len(at))))
        stops = np.r_[begins[1:], len(at)] - 1 if len(at) else begins
        return place[begins] + start, owner[at[begins]], h[place[begins]], at[begins] + start, at[stops] + start + LENGTH

    def records(self, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), RECORD), np.uint8)
        around, left, right = out[:, :AROUND], places - low, high - places
        around[:] = np.lib.stride_tricks.sliding_window_view(self.bytes, AROUND)[places + (BEFORE - LEFT)]
        steps = np.arange(AROUND, dtype=np.int8) - np.int8(LEFT)
        around *= (steps >= -left.astype(np.int8)[:, None]) & (steps < right.astype(np.int8)[:, None])
        out[:, AROUND], out[:, AROUND + 1] = left, right
        return out

    def units(self, named: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """What anchors() gives for documents that have an id, unit by unit."""
        held: list[tuple] = []
        for start in range(0, self.size, STRETCH):
            end = min(self.size, start + STRETCH)
            found = self.anchors(start, end)
            own = named[found[1]]
            held.append(tuple(c[own] for c in found))
            if end == self.size or sum(len(c[0]) for c in held) >= UNIT_ANCHORS:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held = []

    def classes(self, named: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Places, text numbers, hashes, records and classes of the anchors, unit by unit. Classes count on through the block."""
        before = 0
        for places, texts, h, low, high in self.units(named):
            records = self.records(places, low, high)
            classes = equal_rows(records)
            yield places, texts, h, records, classes + before
            before += int(classes.max(initial=-1)) + 1


def packed(x: np.ndarray) -> bytes:
    """An integer array, byte plane by byte plane, compressed: high bytes that hardly vary cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8")[:, 0]


def split(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, columns of its rows) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    bounds = np.flatnonzero(firsts(keys))
    for s, e in zip(bounds, np.r_[bounds[1:], len(keys)]):
        yield int(keys[s]), *(c[s:e] for c in columns)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    release()
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names)


def gathered(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in table.column(n).to_pylist())]) for n in names]


def gathered_bytes(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, table.column("bytes").to_pylist())), np.uint8).reshape(-1, width)


def verdict_rows(blocks: np.ndarray, classes: np.ndarray, masks: np.ndarray) -> list[tuple]:
    """Rows for the blocks: the places to remove, by class."""
    hit = masks > 0
    return [(block, VERDICT, None, packed(c), None, None, packed(m)) for block, c, m in split(blocks[hit], classes[hit], masks[hit])]


def fitting(records: np.ndarray, o: int) -> np.ndarray:
    """Rows that hold the string at place o of their bytes."""
    return np.flatnonzero((o >= LEFT - records[:, AROUND].astype(int)) & (o + LENGTH <= LEFT + records[:, AROUND + 1].astype(int)))


def suffix_rows(records: np.ndarray, blocks: np.ndarray, classes: np.ndarray, docs: np.ndarray, parts: int) -> list[tuple]:
    """The suffixes of wide anchors: those of the least document here go on to groups by their hash, the others are settled here."""
    held, masks = [], np.zeros(len(records), np.uint64)
    for o in range(PLACES):
        fits = fitting(records, o)
        if not len(fits):
            continue
        strings = np.zeros((len(fits), LENGTH + 6), np.uint8)
        strings[:, :LENGTH] = records[fits, o : o + LENGTH]
        least = least_of(equal_rows(strings), docs[fits])
        masks[fits[docs[fits] > least]] |= ONE << np.uint64(o)
        go = docs[fits] == least
        h = np.zeros(int(go.sum()), np.uint64)
        for column in strings[go].view("<u8").T:
            h = mixed(h, column)
        held.append((h % np.uint64(parts), blocks[fits][go], classes[fits][go], docs[fits][go], strings[go], np.full(len(h), o)))
    rows = verdict_rows(blocks, classes, masks)
    if held:
        for part, b, c, d, s, o in split(*map(np.concatenate, zip(*held))):
            rows.append((part, SUFFIX, packed(b), packed(c), packed(d), zstandard.compress(s.tobytes(), 1), packed(o)))
    return rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, other columns) -> blocks of whole documents of about BLOCK_BYTES; a longer document is a block of its own."""
    task, held, size, count = TaskContext.get().partitionId(), [], 0, 0

    def block() -> pa.RecordBatch:
        nonlocal held, size, count
        rows = pa.Table.from_batches(held).combine_chunks()
        held, size, count = [], 0, count + 1
        texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
        ids = rows.column(0)
        flags = pc.is_valid(ids).to_numpy() * NAMED + pc.is_null(rows.column(1)).to_numpy() * TEXTLESS
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema.remove(0).remove(0), options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.drop_columns(rows.column_names[:2]))
        numbers = (pc.fill_null(ids, 0).to_numpy(), flags, np.array([*map(len, texts)], np.int64))
        return batch_of([((task << 32) + count, *map(packed, numbers), zstandard.compress(b"".join(texts), 3), sink.getvalue().to_pybytes())], BLOCKS)

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            if size and size + n > BLOCK_BYTES:
                held.append(batch.slice(start, i - start))
                start = i
                yield block()
            size += n
        held.append(batch.slice(start))
    if any(b.num_rows for b in held):
        yield block()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, Block]:
    return unpacked(row["ids"]), unpacked(row["flags"]), Block(unpacked(row["lengths"]), zstandard.decompress(row["bytes"]))


def lookup_keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Group and 32 bits of each distinct hash of a unit, in one number."""
    return np.unique((h % np.uint64(parts)) << np.uint64(32) | h >> np.uint64(32))


def block_keys(block: Block, named: np.ndarray, parts: int) -> np.ndarray:
    """The keys of all units of a block, sorted; a key of several units is repeated."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(lookup_keys(h, parts) for _, _, h, _, _ in block.units(named))]))


def _look_up(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                _, flags, block = _unpack(row)
                keys = block_keys(block, flags & NAMED > 0, parts)
                yield batch_of([(part, row["block"], packed(np.diff(low, prepend=np.uint64(0)))) for part, low in split((keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF))], LOOKUPS)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Per row one bit for each of its keys: whether the group has it more than once."""
    sent = [np.cumsum(unpacked(x)) for x in table.column("hashes").to_pylist()]
    _, at, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = np.split(counts[at] > 1, np.cumsum([*map(len, sent)])[:-1])
    rows = [(block, part, zstandard.compress(np.packbits(x).tobytes(), 1)) for block, part, x in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), shared)]
    return pa.Table.from_batches([batch_of(rows, ANSWERS)])


def _record_rows(lookup_parts: int, parts: int, wide: int):
    """A block and the answers it got -> the classes of its units whose anchors others have, dealt by their anchors; those of wide anchors suffix by suffix."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        ids, flags, block = _unpack(row)
        named = flags & NAMED > 0
        keys = block_keys(block, named, lookup_parts)
        answers = dict(zip(right.column("part").to_pylist(), right.column("shared").to_pylist()))
        known = [keys[:0]]
        for part, own in split((keys >> np.uint64(32)).astype(np.int64), keys):
            bits = np.unpackbits(np.frombuffer(zstandard.decompress(answers[part]), np.uint8), count=len(own))
            known.append(own[bits > 0])
        shared = np.concatenate(known)
        rows = []
        for _, texts, h, records, classes in block.classes(named):
            docs = ids[texts]
            order = np.lexsort((docs, classes))
            one = order[firsts(classes[order])]  # an occurrence in the least document of each class
            one = one[np.argsort(h[one], kind="stable")]
            count = per_group(firsts(h[one]), np.ones(len(one), np.int64))
            own_keys = (h[one] % np.uint64(lookup_parts)) << np.uint64(32) | h[one] >> np.uint64(32)
            one = one[(count > 1) | np.isin(own_keys, shared)]
            h, records, classes, docs = h[one], records[one], classes[one], docs[one]
            starts = firsts(h)
            many = per_group(starts, np.ones(len(h), np.int64)) > wide
            if many.any():
                rows += suffix_rows(records[many], np.full(int(many.sum()), row["block"]), classes[many], docs[many], parts)
            for kind, which in ((GROUPED, ~many), (MARKED, many & starts)):
                for part, c, d, x in split((h[which] % np.uint64(parts)).astype(np.int64), classes[which], docs[which], records[which]):
                    rows.append((part, kind, packed(np.full(len(c), row["block"])), packed(c), packed(d), zstandard.compress(x.tobytes(), 3), None))
        return pa.Table.from_batches([batch_of(rows, ROWS)])

    return run


def sort_buckets(anchors: np.ndarray, docs: np.ndarray, records: np.ndarray) -> np.ndarray:
    """Mask per row of the places whose suffix also comes from an earlier document. anchors: their numbers, docs: ids, records: distinct ones."""
    padded = np.zeros((len(records), RECORD + 8), np.uint8)
    padded[:, :RECORD] = records

    def word(at: int, size: int) -> np.ndarray:
        return np.ascontiguousarray(padded[:, at : at + 8]).view(">u8")[:, 0].astype(np.uint64) >> np.uint64(64 - 8 * size)

    nearest = [next(p for p in range(o, o + PERIOD) if p % PERIOD in COVER) for o in range(PLACES)]
    ranks = {}
    for p in set(nearest):
        words = [anchors.astype(np.uint64), *(word(p + at, min(8, SAMPLE - at)) for at in range(0, SAMPLE, 8))]
        order = np.lexsort(words[::-1])
        ranks[p] = np.empty(len(order), np.int64)
        ranks[p][order] = np.cumsum(firsts(*(w[order] for w in words))) - 1
    masks = np.zeros(len(records), np.uint64)
    for o, p in enumerate(nearest):
        rows = fitting(records, o)
        if len(rows) < 2:
            continue
        key = ranks[p][rows]
        for at in (*range(o, p), *range(p + SAMPLE, o + LENGTH)):  # the bytes before the sample and those after it
            key = key << 8 | padded[rows, at]
        order = np.argsort(key, kind="stable")
        new = firsts(key[order])
        least = np.minimum.reduceat(docs[rows][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        masks[rows[order]] |= (docs[rows][order] > least).astype(np.uint64) << np.uint64(o)
    return masks


def _judge(parts: int, wide: int):
    """Of one group of anchors: which strings an earlier document has. Suffixes of wide anchors, and what units settled, go on."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rows = passed_on(table.filter(pa.array(kinds >= SUFFIX)))
        own = table.filter(pa.array(kinds < SUFFIX))
        sizes = [len(unpacked(x)) for x in own.column("classes").to_pylist()]
        marked = np.repeat(own.column("kind").to_numpy() == MARKED, sizes)
        blocks, classes, docs = gathered(own, "blocks", "classes", "docs")
        records = gathered_bytes(own, RECORD)
        words = np.ascontiguousarray(records[:, LEFT : LEFT + GRAM]).view("<u8")
        order = np.lexsort(words.T)
        starts = firsts(*words[order].T)
        shared = np.flatnonzero(per_group(starts, np.ones(len(order), np.int64)) > 1)  # alone under its anchor, a class stays as it is
        anchors, order = (np.cumsum(starts) - 1)[shared], order[shared]
        blocks, classes, docs, records, marked = blocks[order], classes[order], docs[order], records[order], marked[order]
        split_up = per_group(firsts(anchors), marked.astype(np.int64)) > 0
        anchors, blocks, classes, docs, records, split_up = (x[~marked] for x in (anchors, blocks, classes, docs, records, split_up))
        if not len(docs):
            return pa.Table.from_batches([batch_of(rows, ROWS)])
        same = equal_rows(records)  # equal records have the same anchor
        least = least_of(same, docs)
        later = docs > least
        rows += verdict_rows(blocks, classes, later * WHOLE)
        order = np.lexsort((docs, same, anchors))
        one = order[firsts(same[order])]  # a row of the least document per class, in the order of the anchors
        starts = firsts(anchors[one])
        count = per_group(starts, np.ones(len(one), np.int64))
        wide_here = np.zeros(int(anchors.max()) + 1, bool)
        wide_here[anchors[one][count > wide]] = True
        wide_here[anchors[split_up]] = True
        sorted_here = one[(count > 1) & ~wide_here[anchors[one]]]
        masks = np.zeros(int(same.max()) + 1, np.uint64)
        masks[same[sorted_here]] = sort_buckets(anchors[sorted_here], docs[sorted_here], records[sorted_here])
        rows += verdict_rows(blocks[~later], classes[~later], masks[same[~later]])
        go = ~later & wide_here[anchors]
        if go.any():
            rows += suffix_rows(records[go], blocks[go], classes[go], docs[go], parts)
        return pa.Table.from_batches([batch_of(rows, ROWS)])

    return run


def passed_on(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c.split()[0]).to_pylist() for c in ROWS.split(", "))))


def _judge_suffixes(table: pa.Table) -> pa.Table:
    """Of one group of single suffixes of wide anchors: which ones an earlier document has. Verdicts go on."""
    kinds = table.column("kind").to_numpy()
    rows = passed_on(table.filter(pa.array(kinds == VERDICT)))
    own = table.filter(pa.array(kinds == SUFFIX))
    if own.num_rows:
        blocks, classes, docs, places = gathered(own, "blocks", "classes", "docs", "places")
        least = least_of(equal_rows(gathered_bytes(own, LENGTH + 6)), docs)
        rows += verdict_rows(blocks, classes, np.where(docs > least, ONE << places.astype(np.uint64), np.uint64(0)))
    return pa.Table.from_batches([batch_of(rows, ROWS)])


def removed_bytes(block: Block, ids: np.ndarray, named: np.ndarray, verdicts: pa.Table) -> np.ndarray:
    """Whether each byte of a block is covered by a removed string."""
    gone = np.zeros(block.size, bool)
    classes, masks = gathered(verdicts, "classes", "places")
    order = np.argsort(classes, kind="stable")
    classes, masks = classes[order], masks[order].view(np.uint64)
    starts = np.flatnonzero(firsts(classes))
    classes, masks = classes[starts], np.bitwise_or.reduceat(masks, starts) if len(masks) else masks
    begins = np.zeros(block.size + 1, bool)
    for places, texts, _, records, own in block.classes(named):
        if not len(own):
            continue
        low = int(own.min())
        mask = np.zeros(int(own.max()) - low + 1, np.uint64)
        here = (classes >= low) & (classes < low + len(mask))
        mask[classes[here] - low] = masks[here]
        mask = mask[own - low]
        docs = ids[texts]
        mask[docs > least_of(own - low, docs)] = WHOLE
        hit = np.flatnonzero(mask)
        places, mask, records = places[hit], mask[hit], records[hit]
        for o in range(PLACES):
            fits = fitting(records, o)
            begins[(places[fits] - LEFT + o)[(mask[fits] >> np.uint64(o) & ONE).astype(bool)]] = True
    at = np.flatnonzero(begins[: block.size])
    for o in range(LENGTH):
        gone[at + o] = True
    return gone


def _digest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and its verdicts -> what is removed of each document."""
    (row,) = left.to_pylist()
    ids, flags, block = _unpack(row)
    gone, rows = removed_bytes(block, ids, flags & NAMED > 0, right), []
    for i, flag, s, e in zip(ids.tolist(), flags.tolist(), block.starts.tolist(), block.ends.tolist()):
        own, data = gone[s:e], block.bytes[BEFORE + s : BEFORE + e]
        count = int(own.sum())
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if count else 0
        rows.append((i if flag & NAMED else None, e - s, count, spans, hashlib.sha256(data[~own] if count else data).hexdigest()))
    return pa.Table.from_batches([batch_of(rows, DIGESTS)])


def _keep(names: list[str]):
    """A block and its verdicts -> the rows of which something remains or that were empty before, with all their columns."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        ids, flags, block = _unpack(row)
        gone = removed_bytes(block, ids, flags & NAMED > 0, right)
        others = iter(pa.ipc.open_stream(row["others"]).read_all().combine_chunks().columns)
        texts, cut, stays = [], [], []
        for flag, s, e in zip(flags.tolist(), block.starts.tolist(), block.ends.tolist()):
            own, data = gone[s:e], block.bytes[BEFORE + s : BEFORE + e]
            count = int(own.sum())
            texts.append(None if flag & TEXTLESS else (data[~own] if count else data).tobytes().decode("utf-8", "ignore"))
            cut.append(count > 0)
            stays.append(count < e - s or s == e)
        columns = []
        for name in names:
            if name == "text":
                columns.append(pa.array(texts, pa.string()))
                continue
            column = next(others)
            if name == "n_chars":
                column = pc.if_else(pa.array(cut), pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(column.type), column)
            columns.append(column)
        return pa.Table.from_arrays(columns, names).filter(pa.array(stays))

    return run


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of the input, to choose how many groups there are."""
    return max(1, min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50))


def _blocks_and_verdicts(docs: DataFrame, others: list[str], wide: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, ...) and verdicts (block, classes, places). Within one query the blocks are shuffled once."""
    size = input_bytes(key_and_text(docs))
    lookup_parts, parts = math.ceil(size / LOOKUP_BYTES), math.ceil(size / GROUP_BYTES)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(docs[f"`{c}`"] for c in others)).toDF("id", "text", *(f"c{i}" for i in range(len(others))))
    blocks = checkpoint(rows.mapInArrow(_pack, BLOCKS))  # written once, so a block and its classes are the same for all that follows
    answers = blocks.mapInArrow(_look_up(lookup_parts), LOOKUPS).groupBy("part").applyInArrow(_answer, ANSWERS)
    records = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_record_rows(lookup_parts, parts, wide), ROWS)
    verdicts = records.groupBy("part").applyInArrow(_judge(parts, wide), ROWS).groupBy("part").applyInArrow(_judge_suffixes, ROWS)
    return blocks, verdicts.select(F.col("part").alias("block"), "classes", "places")


def remove_repeats(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of documents.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
    doc_id. Null and empty texts have no bytes. A row without doc_id is before and after no other: nothing of it
    goes. Rows that share a doc_id don't match each other. Other columns are ignored; an empty table gives an empty result.
    """
    blocks, verdicts = _blocks_and_verdicts(docs, [], wide)
    return blocks.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_digest, DIGESTS)


def without_repeats(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """documents with the remaining text (a character cut in two is dropped) and its length in n_chars, if there's such a column.

    A document of which nothing remains goes; one that was empty before stays, null text stays null. All
    other columns travel with the text, whatever their names. Repeated rows stay; rows without an id are unchanged; an empty table gives an empty one.
    """
    blocks, verdicts = _blocks_and_verdicts(docs, [c for c in docs.columns if c != "text"], wide)
    return blocks.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(_keep(docs.columns), docs.schema)
