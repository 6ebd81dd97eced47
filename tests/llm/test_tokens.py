"""BPE codec and token counts against the tokenizers library."""

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm.bpe_codec import codec, digest_documents, encode_documents
from docloom.llm.ragged_merge import PairTable, merge_ragged
from docloom.llm.token_count import count_documents, counter

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
ODD = ["don't you'll it'S 'sound", "a  b   c\n\n d\t\te ", "\x1c\x1d a\x85b\xa0c　 d", "½ ² Ⅷ 123abc", "!" * 300, " " * 500, "é" * 400, "<|endoftext|><|startoftext|> <|END|>", "🎉👩‍👩‍👧", "x_y __ z"]


def library_ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = codec(BYTES).encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(BYTES, text)
    assert codec(BYTES).decode(ids) == LIBRARY[BYTES].decode(library_ids(BYTES, text), skip_special_tokens=False)
    assert counter(WORDS).count_many([text]) == [len(library_ids(WORDS, text))]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = codec(BYTES).encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(BYTES, text)
    assert codec(BYTES).decode(ids) == text
    assert counter(WORDS).count_many([text]) == [len(library_ids(WORDS, text))]


def test_all_kinds_of_characters():
    """Letters, numbers, marks and capitals of any Unicode version, as the library takes them."""
    spans = ((0, 0x2400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10000, 0x12000), (0x16E00, 0x17100), (0x1D600, 0x1E700), (0x32300, 0x32400))
    characters = [chr(c) for span in spans for c in range(*span)]
    for start in range(0, len(characters), 64):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}\u0301 e{c}\u0323\u0301 " for c in characters[start : start + 64])
        assert np.frombuffer(codec(BYTES).encode(text), "<u4").tolist() == library_ids(BYTES, text), hex(start)
        assert counter(WORDS).count_many([text]) == [len(library_ids(WORDS, text))], hex(start)


def test_documents(spark, small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        source = docs.select("doc_id", "text").collect()
        got = digest_documents(docs, BYTES).collect()
        assert len(got) == len(source)
        expected = []
        for doc_id, text in source:
            ids = library_ids(BYTES, text or "")
            decoded = LIBRARY[BYTES].decode(ids, skip_special_tokens=False)
            expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
        counts = [(i, len((t or "").encode()), n := len(library_ids(WORDS, t or "")), n > 2048) for i, t in source]
        assert sorted(map(repr, map(tuple, count_documents(docs, WORDS).collect()))) == sorted(map(repr, counts))


def test_round_trip(small_docs):
    rows = encode_documents(small_docs, BYTES).select("doc_id", "decoded").collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == {r["doc_id"]: r["text"] for r in small_docs.collect()}


def test_no_documents(no_docs):
    assert digest_documents(no_docs, BYTES).count() == 0 and count_documents(no_docs, WORDS).count() == 0


def test_merge_overlaps():
    table = PairTable([(0, 0, 1), (1, 1, 2), (2, 0, 3)])
    symbols, counts = merge_ragged(np.zeros(15, int), np.array([1, 5, 9]), table)
    assert counts.tolist() == [1, 1, 2] and symbols.tolist() == [0, 3, 2, 3]  # 0 | 1 1 0 -> 2 0 -> 3 | 1 1 1 1 0 -> 2 2 0 -> 2 3


def test_long_texts(monkeypatch):
    """Texts beyond a block are encoded and counted block by block, beside short ones, with dictionaries that are cleared on the way."""
    from docloom.llm import bpe_codec, token_count

    for module in (bpe_codec, token_count):
        monkeypatch.setattr(module, "BLOCK_CHARS", 40)
        monkeypatch.setattr(module, "KEPT_ENTRIES", 5)
    texts = ["short one", *(t * 3 for t in ODD), "", "It's a text<|endoftext|> of words, numbers 12 345 and more. " * 30, "日本語のテキスト " * 20, "short one"]
    for text, ids, n in zip(texts, codec(BYTES).encode_many(texts), counter(WORDS).count_many(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(BYTES, text)
        assert n == len(library_ids(WORDS, text))
