"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import pytest
from palimpsest.llm import periodic_runs as R


def plain(words, shortest=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(shortest, 2 * q):
                if not any(words[s : e - p] == words[s + p : e] for p in range(1, q)):
                    out.append((s, e - s, q))
            i = max(i, s + 1)
    return sorted(out)


def made(draw, n):
    words = []
    while len(words) < n:
        kind = draw.randrange(3)
        if kind == 0 and words:
            words += words[-draw.randrange(1, 30) :] * draw.randrange(1, 5)
        elif kind == 1 and len(words) > 5:
            i = draw.randrange(len(words))
            words += words[i : i + draw.randrange(1, 40)]
        else:
            words += [b"%d" % draw.randrange(draw.choice([1, 2, 4])) for _ in range(draw.randrange(1, 9))]
    return words[:n]


@pytest.mark.parametrize("shortest", [2, 5, 12, 30])
def test_random_words(shortest):
    draw, total = random.Random(shortest), 0
    for _ in range(250):
        words = made(draw, draw.randrange(0, 130))
        want = plain(words, shortest)
        total += len(want)
        for chunk in (1 << 16, 1, draw.randrange(2, 40)):
            assert R.runs_of(words, shortest, chunk) == want
    assert total > 100


def test_chunks_beyond_the_kept_hashes():
    draw = random.Random(9)
    for _ in range(4):
        words = made(draw, 3000)
        words += words[200:1500] * 2
        want = R.runs_of(words)
        assert all(R.runs_of(words, chunk=c) == want for c in (3, 100, 512))
        assert any(q == 1300 for _, _, q in want)


def test_long_constant_and_fibonacci_words():
    assert R.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert R.runs_of(b) == plain(b)


def test_memory_is_in_proportion_to_the_words():
    catchers = R.Catchers()
    draw = random.Random(1)
    for _ in range(40):
        catchers.append(R.np.array([draw.randrange(1000) for _ in range(1000)]))
    assert sum(len(h) for _, h in catchers._hashes.values()) < 8 * catchers.n


def row(doc_id, text, plant):
    words = (text or "").encode().split()
    if plant and doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
        a, new = g % n, []
        for i, w in enumerate(words):
            new.append(words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] if i >= a else w)
        words = new
    runs = plain(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def check(df, plant=True):
    got = R.detected(df, plant).collect()
    want = [row(r.doc_id, r.text, plant) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def test_documents_and_planted_runs(docs):
    short = docs.where("length(text) < 3000")
    got = check(short)
    planted = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert sum(r.n_runs > 0 for r in planted) > len(planted) / 2
    check(short, plant=False)


def test_odd_rows(odd, none, frame):
    for df in (odd, none):
        check(df)
    blanks = "a\x0bb\x0cc\x1cd\xa0e f " * 4
    check(frame([(i, blanks + "x y " * i) for i in range(40)] + [(10, None), (10, "a " * 30), (10, "a " * 30)]))
