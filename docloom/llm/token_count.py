"""Token counts without ids: rank-synchronous array merging.

The distinct pre-tokens of a group of documents that haven't been counted yet are laid out as one
ragged numpy array of symbols (characters of the byte alphabet, the last one with the end-of-word
mark) and merged together; the number of surviving symbols is kept per pre-token in a bounded
dictionary, and a document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.bpe_codec import BLOCK_CHARS, GROUP_BYTES, KEPT_CHARS, KEPT_ENTRIES, LATIN, NEWER, NOT_LATIN, NOT_YET, WHITE_SPACE, byte_alphabet
from docloom.llm.common import key_and_text, record_batch, text_groups
from docloom.llm.ragged_merge import PairTable, merge_ragged

# The pre-token pattern of the word-end vocabulary; white space is dropped.
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
WORD = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
YET_WORD = regex.compile(rf"(?V1){CONTRACTIONS}|[\p{{L}}--[{NEWER}]]+|[\p{{N}}--[{NEWER}]]|[[^{WHITE_SPACE}\p{{L}}\p{{N}}]||[{NEWER}]]+")
LATIN_WORD = re.compile(rf"{CONTRACTIONS}|[{LATIN}]+|[0-9]|[^\t-\r \x85\xa0{LATIN}0-9]+")

#: Marks that the library's composition doesn't know yet, and capitals (first, last, distance of the small letter) that Python's lower() doesn't know yet.
UNKNOWN_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50"
    "\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U00011930\U00011935\U00011938\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44"
    "\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
UNKNOWN = re.compile(f"([{UNKNOWN_MARKS}]+)")
SMALL = {c: c + distance for first, last, distance in NEWER_CAPITALS for c in range(first, last + 1)}
CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


class ArrayTokenCounter:
    """Counts of a word-end BPE vocabulary in the tokenizers JSON format (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, alphabet = data["model"], byte_alphabet()
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        pairs = (p if isinstance(p, list) else p.split(" ") for p in model["merges"])
        self.table = PairTable([(vocab[left], vocab[right], vocab[left + right]) for left, right in pairs])
        names = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.known: dict[str, int] = {}
        self.long_kept = False

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(UNKNOWN.split(text)))
        if text.isascii():
            return text.lower()
        if NOT_LATIN.search(text) and CAPITAL.search(text):
            text = text.translate(SMALL)
        return text.replace("Σ", "σ").lower()  # lower case by character, without a rule for the final sigma

    def _blocks(self, text: str) -> Iterator[list[str]]:
        pattern = (YET_WORD if NOT_YET.search(text) else WORD) if not text.isascii() and NOT_LATIN.search(text) else LATIN_WORD
        if len(text) <= BLOCK_CHARS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while block := list(islice(found, BLOCK_CHARS // 4)):
            yield block

    def _learn(self, words: list[str]) -> None:
        data = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(data), np.uint8)
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        _, counts = merge_ragged(symbols, lengths, self.table)
        self.known.update(zip(words, counts.tolist()))
        self.long_kept |= max(map(len, words)) > KEPT_CHARS

    def forget(self) -> None:
        if len(self.known) > KEPT_ENTRIES or self.long_kept:
            self.known.clear()
            self.long_kept = False

    def learn(self, blocks: list[list[str]]) -> None:
        if new := [*(set().union(*blocks) - self.known.keys())]:
            self._learn(new)

    def _count(self, block: list[str]) -> int:
        return sum(map(self.known.__getitem__, block))

    def _count_long(self, text: str) -> int:
        """Tokens of a text that is cut into several blocks; one of them is held at a time."""
        total = 0
        for block in self._blocks(text):
            self.forget()
            self.learn([block])
            total += self._count(block)
        return total

    def count_many(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text count as one token each."""
        self.forget()
        counts, blocks, long_texts = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and "<|" in text:
                parts = self.special.split(text)
                counts[i] = len(parts) - 1
            for p in map(self.normalise, parts):
                if len(p) > BLOCK_CHARS:
                    long_texts.append((i, p))
                else:
                    blocks += [(i, block) for block in self._blocks(p)]
        self.learn([b for _, b in blocks])
        for i, block in blocks:
            counts[i] += self._count(block)
        for i, p in long_texts:
            counts[i] += self._count_long(p)
        return counts


@lru_cache(maxsize=4)
def counter(path: str) -> ArrayTokenCounter:
    return ArrayTokenCounter(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_documents(docs: DataFrame, vocab_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text, one row per input row.

    Null text counts as empty (0 bytes, 0 tokens); null doc_id stays null; repeated rows give repeated
    results; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocab_path)
        for keys, texts in text_groups(batches, GROUP_BYTES):
            rows = [(key, len(text.encode()), n, n > limit) for key, text, n in zip(keys, texts, tokens.count_many(texts))]
            yield record_batch(rows, COUNTS)

    return key_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
