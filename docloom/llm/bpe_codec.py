"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a cut between
its two bytes is certain. Pre-tokens are split at all such cuts, every fragment is encoded by
itself, and the ids are concatenated. Fragments and pre-tokens repeat heavily, so both are kept in
bounded dictionaries in the worker; a task needs no state from any other, so a lost executor only
costs its own tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.common import key_and_text, record_batch, text_groups
from docloom.llm.ragged_merge import PairTable, merge_ragged

# The pre-token pattern of byte-level BPE, and the Unicode White_Space characters.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
PRETOKEN = regex.compile(
    rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+"
    rf"| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)
#: Letters and numbers of Unicode versions after that of the tokenizers library, which counts them as neither; and the pattern for texts that hold any.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    "\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NOT_YET = regex.compile(f"[{NEWER}]")
YET_PRETOKEN = regex.compile(
    rf"(?V1){CONTRACTIONS}| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+"
    rf"| ?[[^{WHITE_SPACE}\p{{L}}\p{{N}}]||[{NEWER}]]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)
#: The same for texts in which only ASCII digits are numbers and only these characters are letters.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_PRETOKEN = re.compile(
    rf"{CONTRACTIONS}| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r \x85\xa0{LATIN}0-9]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
NOT_LATIN = re.compile("[²³¹¼½¾ɐ-\U0010ffff]")
#: Pre-tokens longer than this aren't kept in the dictionary, so its memory is bounded.
KEPT_CHARS = 64
KEPT_ENTRIES = 60_000
#: A longer text is cut into pre-tokens block by block.
BLOCK_CHARS = 1_000_000
#: Text encoded at once.
GROUP_BYTES = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: printable Latin-1 stands for itself, others count up from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level vocabulary in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = (p if isinstance(p, list) else p.split(" ") for p in data["model"]["merges"])
        merges = [(vocab[left], vocab[right], vocab[left + right]) for left, right in pairs]
        self.inside = np.zeros(65536, bool)
        for token in self.token_bytes.values():
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = True
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = PairTable(merges)
        self.known: dict[str, bytes] = {}
        self.long_kept = False

    def _learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens that aren't known yet, all at once: cut, merge the fragments, concatenate."""
        data = [t.encode() for t in tokens]
        flat = np.frombuffer(b"".join(data), np.uint8)
        starts = np.cumsum([0, *map(len, data)])[:-1]
        pairs = flat[:-1].astype(np.int32) << 8 | flat[1:]
        cut = np.r_[True, ~self.inside[pairs]]
        cut[starts] = True
        begins = np.flatnonzero(cut)
        ids, counts = merge_ragged(self.byte_id[flat], np.diff(np.r_[begins, len(flat)]), self.table)
        per_token = np.add.reduceat(counts, np.searchsorted(begins, starts))
        ends = (4 * np.cumsum(per_token)).tolist()
        raw = ids.astype("<u4").tobytes()
        self.known.update(zip(tokens, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _pretoken_blocks(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text: one block, or several of a long text, made one after the other."""
        pattern = (YET_PRETOKEN if NOT_YET.search(text) else PRETOKEN) if not text.isascii() and NOT_LATIN.search(text) else LATIN_PRETOKEN
        if len(text) <= BLOCK_CHARS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while block := list(islice(found, BLOCK_CHARS // 4)):
            yield block

    def forget(self) -> None:
        """Keep the dictionary bounded: called between groups of documents."""
        if len(self.known) > KEPT_ENTRIES or self.long_kept:
            self.known.clear()
            self.long_kept = False

    def learn(self, blocks: list[list[str]]) -> None:
        """Encode the pre-tokens of some blocks that aren't known yet in one go."""
        new = set().union(*blocks) - self.known.keys()
        if new:
            self.long_kept |= max(map(len, new)) > KEPT_CHARS
            self._learn([*new])

    def _ids(self, block: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, block))

    def _encode_long(self, text: str) -> bytes:
        """Ids of a text that is cut into several blocks; one of them is held at a time."""
        out = []
        for block in self._pretoken_blocks(text):
            self.forget()
            self.learn([block])
            out.append(self._ids(block))
        return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Special strings in it become their ids."""
        self.forget()
        parts = [self.special_split.split(t) if self.special_split and any(s in t for s in self.special) else [t] for t in texts]
        blocks = [b for ps in parts for p in ps[::2] if len(p) <= BLOCK_CHARS for b in self._pretoken_blocks(p)]
        self.learn(blocks)
        short = [self._ids(b) for b in blocks]  # before a long text clears the dictionary
        found, out = iter(short), []
        for ps in parts:
            ids = [struct.pack("<I", self.special[p]) if i % 2 else next(found) if len(p) <= BLOCK_CHARS else self._encode_long(p) for i, p in enumerate(ps)]
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and vocabulary file."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian u32), decoded text and the digests of both, one row per input row.

    Null text counts as empty (no ids, empty decoded text); null doc_id stays null; repeated rows give
    repeated results; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path)
        for keys, texts in text_groups(batches, GROUP_BYTES):
            rows = []
            for key, ids in zip(keys, bpe.encode_many(texts)):
                decoded = bpe.decode(ids)
                rows.append((key, len(ids) // 4, ids, decoded, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield record_batch(rows, ENCODED)

    return key_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string")


def digest_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """The digests of encode_documents() alone, so ids and texts never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path)
        for keys, texts in text_groups(batches, GROUP_BYTES):
            rows = [(key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) for key, ids in zip(keys, bpe.encode_many(texts))]
            yield record_batch(rows, DIGESTS)

    return key_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
