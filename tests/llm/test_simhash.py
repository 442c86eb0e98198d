"""SimHash groups against all pairs, and edge rows."""

import random

import xxhash

from palimpsest.llm import simhash_dedup as S
from palimpsest.llm.components import components

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id reachable over links of three bits, row by row."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            low[find(i)] = min(ident, low.get(find(i), ident))
    return sorted(((ident, f"{prints[i]:016x}", low.get(find(i))) for i, (ident, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, S.near_duplicates(df).collect()), key=repr)


def test_matches_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == plain_groups(rows)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == plain_groups(rows)
    assert S.near_duplicates(none).count() == 0


def test_links_miss_nothing(spark):
    draw = random.Random(5)
    found = {draw.getrandbits(64) for _ in range(300)}
    for f in sorted(found):
        for k in range(draw.randrange(5)):
            found.add(f ^ sum(1 << b for b in draw.sample(range(64), k)))
    signed = [f - (1 << 64) if f >> 63 else f for f in found]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & MASK).bit_count() <= 3}
    assert {tuple(r) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()} == want


def test_keeps_one_of_each_group(odd, none):
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns
    # The blank texts and the equal ones form a group each; one id names two different texts.
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 4, 6, 7]
    assert S.keep_first(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (None, 3)]
    df = components(spark.createDataFrame(links, "a long, b long"))
    got = dict(map(tuple, df.collect()))
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1200)}
