"""Pieces against the tokenizer itself; sequences against their limits and bound."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows, limit):
    tokenizer = Tokenizer.from_file(PATH)
    for ident, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at : at + limit], "<u4")
            yield ident, k, at, len(part), zlib.crc32(part.tobytes())


def got_pieces(df, limit=P.LIMIT):
    return [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in P.pieces(df, PATH, limit).collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_pieces(docs, odd, none):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert same(got_pieces(df, 512), plain_pieces(rows, 512))
    assert got_pieces(none) == []


def test_words_are_tokenised_as_within_their_text():
    tokenizer, encode = Tokenizer.from_file(PATH), P.Encoder(PATH)
    draw = random.Random(1)
    letters = "abcXYZ019 \t\n'’sdé½²ßÀ-.,!?<|>_#@İΣς́\x1c\xa0中🙂"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += ["it's we'll I'D don't 'tis ''s", "<|endoftext|> x", "a\x85b", "l'été coûte 3½ €"]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == ids, t


def check(df, rows, limit):
    by = {}
    for r in df.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert sum(map(len, by.values())) == rows
    return len(by)


def test_sequences(docs, odd, none, spark):
    for df in (docs, odd):
        parts = P.pieces(df, PATH).drop("ids")
        n = check(P.packed(parts), parts.count(), P.LIMIT)
        assert n <= 1 + -(-sum(r.length for r in parts.collect()) // P.LIMIT)
    assert P.packed(P.pieces(none, PATH).drop("ids")).count() == 0
    draw = random.Random(4)
    rows = [(i, draw.randrange(1, 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    assert check(P.packed(df, 100, 200), 900, 100) <= 1.02 * sum(n for _, n in rows) / 100 + 5


def test_local_search_empties_bins():
    lengths = np.array([60, 45, 35, 30, 30])  # best fit of falling length alone needs three bins
    first = [[0, 2], [1, 3], [4]]
    done = P.improved([list(b) for b in first], lengths, 105)
    assert len(done) == 2 and sorted(k for b in done for k in b) == [0, 1, 2, 3, 4]
    assert all(lengths[b].sum() <= 105 for b in done)
