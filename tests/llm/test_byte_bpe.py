"""Byte-level BPE against the tiktoken library and a plain merge loop."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from palimpsest.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = [*" \t\n\r  '\x1c\x85\xa0  éß漢字1٣²!.-sSre\x00\U0001f600", "'ll", " the", "ing", "aaaa", "  ", "\r\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def want():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks_of(PATH), special_tokens={})
    return lambda text: np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_random_texts(codec, want):
    draw = random.Random(4)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(40))) for _ in range(3000)]
    ids = codec.encoded(texts)
    assert ids == [want(t) for t in texts] and [codec.decoded(i).decode() for i in ids] == texts


def test_characters_of_all_planes(codec, want):
    for a in range(0, 0x20000, 997):
        text = "".join(f"a{c}1{c}{c} b {c} 2 {c}  {c}.{c}\n" for c in map(chr, range(a, a + 12)) if not 0xD800 <= ord(c) < 0xE000)
        assert codec.encoded([text]) == [want(text)]


def test_sections(codec, want):
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(draw.choice(PIECES) for _ in range(60))
        parts = list(B.sections(text, 7))
        assert "".join(parts) == text and b"".join(codec.encoded(parts)) == want(text)
    long = "ab" * 30_000
    assert codec.encoded([long]) == [want(long)]


def test_memory_is_emptied(monkeypatch, want):
    monkeypatch.setattr(B, "REMEMBERED", 5)
    codec = B.Codec(PATH, public_tokenizers.PATTERN)
    for text in ("one two three four five six", "two seven", "eight nine " + "ten" * 50, "one two"):
        assert codec.encoded([text, text]) == [want(text)] * 2
    assert max(map(len, codec._words)) <= B.LONGEST


def test_ranks_out_of_order(tmp_path):
    """A merge that opens a pair of a lower rank: the word goes by itself."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"cab", b"ab", b"abab", b"cabab", b"bb", b"ca"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    codec = B.Codec(str(path), r"\S+|\s+")
    draw = random.Random(6)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 14))) for _ in range(3000)})
    raw = [w.encode() for w in words]
    assert codec.replayed(raw) == [codec._alone(w) for w in raw]
    plain = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encoded(words) == [np.array(plain.encode_ordinary(w), "<u4").tobytes() for w in words]


def check(df, want, **more):
    got = B.round_trip(df, PATH, public_tokenizers.PATTERN, **more).collect()
    rows = []
    for r in df.select("doc_id", "text").collect():
        ids = want(r.text or "")
        rows.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_documents(docs, want):
    check(docs, want)


def test_odd_rows(odd, none, want):
    for df in (odd, none):
        check(df, want, section=50)
