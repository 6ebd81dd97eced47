"""Statistics of whole texts, on UTF-8 bytes; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np

from docloom.llm.common import SPACE

#: Fixed value: the symbol characters of the base rules.
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, LOUD, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:"
#: Fixed value: the pattern of a word.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Longer texts (in bytes) are read in blocks of so many words.
LONG_BYTES, BLOCK_WORDS = 1_000_000, 100_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_loud", "n_stops", "n_runs")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    distinct = len(set(windows))
    if distinct == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    r"""\n-split lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def without(data: bytes, characters: bytes) -> int:
    """How many of these ASCII characters there are."""
    return len(data) - len(data.translate(None, characters))


def base_stats(data: bytes, words: list[bytes], n_chars: int) -> tuple[int, int, int, int, int]:
    return (len(words), n_chars - without(data, SPACE), without(data, SYMBOLS), repeated_lines(data), repeated_words(words))


def word_numbers(data: bytes) -> tuple[np.ndarray, int]:
    """The words of a long text as numbers, equal ones alike, and how many there are. Only the distinct words and one block are held as objects."""
    known: dict[bytes, int] = {}

    def blocks() -> Iterator[np.ndarray]:
        words = (m.group() for m in WORD.finditer(data))
        while block := [known.setdefault(w, len(known)) for _, w in zip(range(BLOCK_WORDS), words)]:
            yield np.array(block, np.int32)

    return np.concatenate([np.zeros(0, np.int32), *blocks()]), len(known)


def repeated_numbers(words: np.ndarray) -> int:
    """repeated_words() of numbered words."""
    if len(words) < 3:
        return 0
    first, second, third = words[:-2], words[1:-1], words[2:]
    order = np.lexsort((third, second, first))
    same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]]) & (third[order[1:]] == third[order[:-1]])
    covered = np.zeros(len(words), bool)
    for hit in (order[1:][same], order[:-1][same]):
        for shift in range(3):
            covered[hit + shift] = True
    return int(covered.sum())


def long_stats(data: bytes, n_chars: int) -> tuple[tuple[int, ...], int, int]:
    """BASE of a long text, its distinct words and its runs, in blocks."""
    words, distinct = word_numbers(data)
    lines, with_word = set(), 0
    for line in io.BytesIO(data):
        line = line.rstrip(b"\n")
        if line.strip(SPACE):
            with_word += 1
            lines.add(line)
    base = (len(words), n_chars - without(data, SPACE), without(data, SYMBOLS), with_word - len(lines), repeated_numbers(words))
    return base, distinct, int((words[1:] == words[:-1]).sum())


def all_stats(text: str) -> tuple[int, ...]:
    """BASE then EXTRA, all of the whole text. What a long text takes beyond itself is a few bytes per word, and its distinct words and lines."""
    data = text.encode()
    if len(data) > LONG_BYTES:
        base, distinct, runs = long_stats(data, len(text))
    else:
        words = data.split()
        base, distinct, runs = base_stats(data, words, len(text)), len(set(words)), sum(map(bytes.__eq__, words, words[1:]))
    return (*base, len(text), data.count(b"\n") + 1, distinct, without(data, UPPER), without(data, DIGITS), without(data, LOUD), without(data, STOPS), runs)


def ratios(stats: np.ndarray) -> np.ndarray:
    """Rows of all_stats() as scale-free features (FEATURES), finite for empty texts too."""
    s = dict(zip(BASE + EXTRA, stats.astype(float).T))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words, s["n_distinct_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_loud"] / chars, s["n_stops"] / chars, s["n_runs"] / words,
    ])


FEATURES = ("log_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "loud_ratio", "stop_ratio", "run_ratio")
