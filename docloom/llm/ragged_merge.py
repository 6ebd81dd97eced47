"""Rank-synchronous pair merging over ragged numpy arrays.

A batch of symbol sequences lies in one flat array. In each round every sequence looks up the rank of
each neighbouring pair, takes its lowest one, and all its occurrences are joined at once (left to
right where they overlap). Sequences without a known pair leave the batch. Memory is a few words for
each symbol of the batch.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
EMPTY = np.int64(-1)


class PairTable:
    """(left, right) -> (rank, joined) as an open-addressing table in numpy arrays."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: (left, right, joined) in the order of their ranks; a pair given twice keeps its last rank."""
        ranks = {left << 20 | right: (rank, joined) for rank, (left, right, joined) in enumerate(merges)}
        self.bits = max(4, (4 * len(ranks)).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.joined = np.full(size, EMPTY), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        keys = np.fromiter(ranks, np.int64, len(ranks))
        for key, slot in zip(keys.tolist(), self.slots(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = slot + 1 & size - 1
            self.keys[slot] = key
            self.rank[slot], self.joined[slot] = ranks[key]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 20 | right
        slots = self.slots(keys)
        there = self.keys[slots]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        found = self.keys[slots] == keys
        return np.where(found, self.rank[slots], NONE), self.joined[slots]


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end. Returns the surviving symbols, in the given order, and their number per sequence.

    symbols: flat int array; lengths: one positive length per sequence.
    """
    n = len(lengths)
    counts = np.zeros(n, np.int64)
    sequence = np.repeat(np.arange(n), lengths)
    symbols = symbols.astype(np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at these positions."""
        follow = np.minimum(at + 1, len(symbols) - 1)
        rank, joined = table.find(symbols[at], symbols[follow])
        rank[(sequence[follow] != sequence[at]) | (follow == at)] = NONE
        return rank, joined

    if len(symbols):
        rank, joined = ranked(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        ended = lowest == NONE
        if ended.any():
            out = np.repeat(ended, sizes)
            done.append((sequence[out], symbols[out]))
            counts[sequence[starts[ended]]] = sizes[ended]
            symbols, sequence, rank, joined = symbols[~out], sequence[~out], rank[~out], joined[~out]
            lowest, sizes = lowest[~ended], sizes[~ended]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        at = np.flatnonzero(hit)
        # In a run of overlapping hits (the same symbol again and again) every other one is taken.
        if len(at) > 1 and (np.diff(at) == 1).any():
            order = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], order, 0))
            at = at[(order - first) % 2 == 0]
        symbols[at] = joined[at]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        moved = at - np.arange(len(at))
        symbols, sequence, rank, joined = symbols[stays], sequence[stays], rank[stays], joined[stays]
        touched = np.zeros(len(symbols), bool)
        touched[moved] = touched[np.maximum(moved - 1, 0)] = True
        changed = np.flatnonzero(touched)
        rank[changed], joined[changed] = ranked(changed)
    if not done:
        return symbols, counts
    owner, survivors = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    return survivors[np.argsort(owner, kind="stable")], counts
