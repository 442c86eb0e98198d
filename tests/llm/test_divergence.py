"""Source divergence against plain sums over all kept terms."""

import re
from collections import Counter, defaultdict

from palimpsest.llm import source_divergence as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return [1 + 10**9 * (count[t] + 1) // total for t in kept]

        sources = sorted(s for g, s in groups if g == lang)
        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p - q) ** 2 // q for p, q in zip(own[s], own[o], strict=True)), o) for o in sources if o != s]
            listed = [
                (-((p - q) ** 2 // q), t)
                for t, p, q in zip(kept, own[s], whole, strict=True)
                if counts[lang, s][t] > 0 and p > q
            ]
            for part, ranked, most in (("pair", pairs, None), ("term", listed, 200)):
                ranked = sorted(ranked, key=lambda x: (x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def check(df):
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    got = [tuple(r) for r in S.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    return got


def test_tokens_are_the_pattern():
    text = "".join(chr(c) for c in range(1, 0x250)) + "A-B c9D\x00é ÀB x\xa0y 漢字_"
    assert [t.decode() for t in S.terms(text.encode())] == TERM.findall(text.translate(LOWER))


def test_whole_table(docs):
    assert check(docs)


def test_small_and_odd_groups(frame, odd, none):
    texts = ["a b c a", "a b", "A c! c", "", None, "b é é", "É b a", "c" * 4000 + " a", "z"]
    rows = [(i, texts[i % 9], (None, "", "en", "fr")[i % 4], (None, "s1", "s2", "", "é")[i % 5]) for i in range(60)]
    got = check(frame(rows))
    assert {r[0] for r in got} == {"", "en", "fr"}
    check(odd)
    assert check(none) == []


def test_no_kept_terms_gives_pairs_of_zero(frame):
    got = check(frame([(1, "a", "xx", "s1"), (2, "b", "xx", "s2"), (3, None, "xx", None)]))
    assert [r[4] for r in got] == [0] * 6 and {r[2] for r in got} == {"pair"}


def test_hot_group_and_small_memory(frame, monkeypatch):
    monkeypatch.setattr(S, "HELD", 20)
    rows = [(i, f"common words {i % 40} w{'abc'[i % 3]} x{'abcdefg'[i % 7]}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    check(frame(rows))


def test_shares_at_large_counts(spark):
    df = spark.sql("SELECT 9000000000000L AS n, 70000000000007L AS d")
    assert df.select(S._share("n", "d")).first()[0] == 1 + 10**9 * (9 * 10**12 + 1) // 70000000000007
