"""Repeated passages against all runs of 50 words, compact windows by brute force, edge rows."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import substring_dedup as S


def runs(rows):
    seen = defaultdict(set)
    for ident, text in rows:
        w = (text or "").lower().split()
        for k in range(len(w) - S.WORDS + 1):
            seen[tuple(w[k : k + S.WORDS])].add((ident, k))
    return [g for g in seen.values() if len({i for i, _ in g}) > 1]


def covered(df):
    out = defaultdict(set)
    for r in S.repeated_passages(df).collect():
        out[r.doc_id].update(range(r.start, r.stop))
    return out


def test_every_repeated_run_is_covered(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = covered(docs)
    for group in runs(rows):
        for ident, k in group:
            assert ident in got and k in got[ident]


def made(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def test_planted_passages(frame):
    draw = random.Random(2)
    passage = made(draw, 60)
    near = [*passage]
    near[30] = "changed"
    rows = [(i, " ".join([*made(draw, 70), *(passage if i % 3 == 0 else []), *made(draw, 40)])) for i in range(90)]
    rows += [(200, " ".join(made(draw, 30) + near + made(draw, 30))), (201, " ".join(passage[:40] + made(draw, 60)))]
    found = S.repeated_passages(frame(rows)).collect()
    assert {r.doc_id for r in found} == {*range(0, 90, 3), 200}
    assert {r.class_id for r in found} == {0} and {r.class_size for r in found} == {31}
    for r in found:
        if r.doc_id < 90:
            assert r.start <= 72 and r.stop >= 128


def test_windows():
    draw = random.Random(1)
    texts = [[w.encode() for w in made(draw, n)] for n in (50, 304, 51, 120)]
    together, starts, gaps = S.joined(texts)
    got = list(S.windows(together, gaps))
    for t, begin in zip(texts, starts.tolist(), strict=True):
        n = len(t) - S.SHINGLE + 1
        sh = S.joined([t])[0][:n]
        assert (together[begin : begin + n] == sh).all()
        for k, (_, c, left, right) in enumerate(got):
            h = S._mixed(sh + np.uint64((k + 1) * int(S._M) % 2**64))
            want = sorted({i + int(h[i : i + S.LENGTH].argmin()) for i in range(n - S.LENGTH + 1)})
            mine = (c >= begin) & (c < begin + len(t))
            assert want == (c[mine] - begin).tolist()
            for p, lo, hi in zip(*((x[mine] - begin).tolist() for x in (c, left, right)), strict=True):
                assert h[lo : hi + 1].min() == h[p]
                assert (lo == 0 or h[lo - 1] < h[p]) and (hi == n - 1 or h[hi + 1] < h[p])


def test_odd_rows(odd, none):
    assert {r.doc_id for r in S.repeated_passages(odd).collect()} == set()
    assert S.repeated_passages(none).count() == 0


def test_passage_twice_in_one_document(frame):
    draw = random.Random(1)
    rows = []
    for i in range(0, 20, 2):
        passage = made(draw, 60)
        rows += [(i, " ".join([*made(draw, 70), *passage, *made(draw, 60), *passage, *made(draw, 40)]))]
        rows += [(i + 1, " ".join([*made(draw, 70), *passage, *made(draw, 40)]))]
    got = covered(frame(rows))
    for i in range(0, 20, 2):
        assert {*range(70, 130), *range(190, 250)} <= got[i] and set(range(70, 130)) <= got[i + 1]


def test_phrase_with_many_continuations(frame):
    draw = random.Random(4)
    phrase, before, after = made(draw, 30), [made(draw, 30) for _ in range(12)], [made(draw, 30) for _ in range(12)]
    rows = [(12 * i + k, " ".join([*made(draw, 60), *before[i], *phrase, *after[k], *made(draw, 60)])) for i in range(12) for k in range(12)]
    got = covered(frame(rows))
    for group in runs(rows):
        for ident, k in group:
            assert set(range(k, k + S.WORDS)) <= got[ident]


def test_word_put_in_or_left_out(frame):
    draw = random.Random(6)
    rows = []
    for i in range(0, 80, 2):
        passage = made(draw, 50)
        other = [*passage[:25], "new", *passage[25:]] if i % 4 else [*passage[:24], *passage[25:]]
        rows += [(k, " ".join([*made(draw, 60), *p, *made(draw, 60)])) for k, p in ((i, passage), (i + 1, other))]
    # A changed word in a passage may leave no common smallest hash; most have one.
    assert len(covered(frame(rows))) >= 72


def test_no_near_pair_of_a_signature_is_left_out(frame):
    draw = random.Random(8)
    # All texts share 40 shingles, too few; every two of them share 41, which are enough.
    phrase, rows = made(draw, 44), []
    for i in range(0, 40, 2):
        rows += [(k, " ".join([*made(draw, 40), f"own{i}", *phrase, *made(draw, 40)])) for k in (i, i + 1)]
    names = {r.doc_id: r.class_id for r in S.repeated_passages(frame(rows)).collect()}
    assert sum(i in names and names[i] == names.get(i + 1) for i in range(0, 40, 2)) >= 18


def test_blocks_give_the_same(frame, monkeypatch):
    draw = random.Random(9)
    passage = made(draw, 56)
    rows = []
    for i in range(60):
        mine = [*passage]
        mine[i % 50] = f"y{i % 7}"
        rows += [(i, " ".join([*made(draw, 50), *mine, *made(draw, 50)]))]
    want = sorted(tuple(r) for r in S.repeated_passages(frame(rows)).collect())
    monkeypatch.setattr(S, "BLOCK", 7)
    assert want and sorted(tuple(r) for r in S.repeated_passages(frame(rows)).collect()) == want


def similar_by_hand(x, y):
    """Reach of stretches of x, and of y, where those of x have ``LENGTH``; by the definition, one pair at a time."""
    side, best, other = S._SIDE, [0, 0], [0, 0]
    cx, cy = ({k - side: int(v) for k, v in enumerate(w[2:]) if v} for w in (x, y))
    for dl, dr in S._MOVES:
        need = int(np.ceil((2 * S.LENGTH + dl + dr) * S.SIMILARITY / (1 + S.SIMILARITY) - 1e-9))
        shift = {-1: range(min(0, dl), max(0, dl) + 1), 1: range(min(0, dr), max(0, dr) + 1)}
        for a in range(S.LENGTH):
            b, total = S.LENGTH - 1 - a, [1, 1]
            if a > x[0] or b > x[1] or not 0 <= a + dl <= y[0] or not 0 <= b + dr <= y[1]:
                continue
            for way, n, d in ((-1, a, dl), (1, b, dr)):
                total[0] += sum(any(cx.get(way * k) == cy.get(way * (k + e), -1) and k + e > 0 for e in shift[way]) for k in range(1, n + 1))
                total[1] += sum(any(cy.get(way * k) == cx.get(way * (k - e), -1) and k - e > 0 for e in shift[way]) for k in range(1, n + d + 1))
            if min(total) >= need:
                best = [max(best[0], a + 1), max(best[1], b + 1)]
                other = [max(other[0], a + dl + 1), max(other[1], b + dr + 1)]
    return best, other


def test_similar_pairs_by_hand():
    draw = random.Random(3)
    lines = []
    base = [draw.randrange(1, 256) for _ in range(200)]
    for i in range(24):
        codes = [*base]
        for _ in range(i % 4):
            at = draw.choice([k for k in range(60, 140) if k != 100])
            if draw.random() < 0.5:
                codes[at : at + 3] = [draw.randrange(1, 256) for _ in range(3)]
            elif at > 100:
                codes = [*codes[:at], draw.randrange(1, 256), *codes[at:]]
            else:
                codes = [*codes[1:at], draw.randrange(1, 256), *codes[at:]] if draw.random() < 0.5 else [0, *codes[:at], *codes[at + 1 :]]
        xl, xr = draw.choice([(47, 47), (20, 47), (47, 30)])
        body = codes[100 - S._SIDE : 101 + S._SIDE]
        body = [v if -xl <= k - S._SIDE <= xr else 0 for k, v in enumerate(body)]
        lines.append([xl, xr, *body])
    x = np.array(lines, np.uint8)
    apart = ~np.eye(len(x), dtype=bool)
    good, mine, theirs = S._similar(x, x, apart)
    hand = [[similar_by_hand(p, q) if i != j else ([0, 0], [0, 0]) for j, q in enumerate(x.tolist())] for i, p in enumerate(x.tolist())]
    want = [[np.maximum(hand[i][j][0], hand[j][i][1]) for j in range(len(x))] for i in range(len(x))]
    assert (good == np.array(want).any(2)).all() and good.any() and not good[apart].all()
    assert (mine == np.array(want).max(1)).all()


def test_pairs_passed_over_are_not_similar():
    draw = random.Random(5)
    lines = []
    # Repeated words of many lengths, each ahead of another repeated word, beside near copies of one passage.
    base = [draw.randrange(1, 256) for _ in range(S._SIDE)]
    for i in range(120):
        run, own = draw.randrange(1, 47), [draw.randrange(1, 256) for _ in range(4)]
        after = ([9] * run + own + [draw.randrange(20, 40)] * 50)[: S._SIDE]
        lines.append([0, S._SIDE, *[0] * S._SIDE, 9, *after])
        codes = [*base]
        for _ in range(draw.randrange(9)):
            codes[draw.randrange(S._SIDE)] = draw.randrange(1, 256)
        lines.append([2, 45, *[0] * (S._SIDE - 2), 7, 8, 9, *codes[:45], 0, 0])
    x = np.array(lines, np.uint8)
    apart = np.triu(np.ones((len(x), len(x)), bool), 1)
    near = S._near(x, x, apart)
    i, j = np.nonzero(apart)
    similar = np.zeros(apart.shape, bool)
    similar[i, j] = S._matched(x[i][:, None], x[j][:, None], np.ones((len(i), 1), bool))[0][:, 0]
    assert similar.any() and not (similar & ~near).any()
    assert near.sum() < 0.4 * apart.sum()


def test_few_pairs_of_repeated_words_are_verified(frame, monkeypatch):
    # A word repeated on and on gives a form for each length left of it; most can hold no stretch, or are settled early.
    draw, pairs, verified = random.Random(12), [], S._matched
    rows = [(i, " ".join([*made(draw, 60), *["again"] * draw.randrange(60, 160), *made(draw, 60)])) for i in range(40)]
    docs = frame(rows).select("doc_id", "text")
    bits = np.full(1 << (S.FILTER_BITS - 3), 255, np.uint8)
    forms = S._forms(S._around(docs, bits).withColumn("form", F.xxhash64("sig", "ctx")))
    blocks = S._blocks(forms).collect()
    assert blocks and all(r.ctx[0] + r.ctx[1] >= S.LENGTH - 1 - S.SHIFT for r in blocks)
    groups = defaultdict(list)
    for r in forms.collect():
        groups[r.sig].append(r)
    largest = max(groups.values(), key=len)
    table = pa.table({
        "pair": [0] * len(largest), "sig": [r.sig for r in largest], "own": [0] * len(largest), "within": [True] * len(largest),
        "form": [r.form for r in largest], "ctx": [r.ctx for r in largest], "fk": [r.fk for r in largest], "fc": [r.fc for r in largest],
        "mk": [r.mk for r in largest],
    })

    def counted(x, y, apart):
        pairs.append(apart.size)
        return verified(x, y, apart)

    monkeypatch.setattr(S, "_matched", counted)
    assert sum(b.num_rows for b in S._settled(table.sort_by("ctx")))
    assert sum(pairs) < 0.1 * len(largest) ** 2 / 2


def test_connected_lines():
    draw = random.Random(13)
    lead, links = np.arange(60), []
    for _ in range(4):
        more = [(draw.randrange(60), draw.randrange(60)) for _ in range(10)]
        links += more
        lead = S._connect(lead, *np.array(more).T)
    want = list(range(60))
    for _ in range(60):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert lead.tolist() == want


def settled(groups):
    """What ``_settled`` finds for groups of lines, one a signature, each line in a document of its own."""
    lines = [(g, bytes(w)) for g, group in enumerate(groups) for w in sorted(bytes(w) for w in group)]
    n = len(lines)
    table = pa.table({
        "pair": [g for g, _ in lines], "sig": [g for g, _ in lines], "own": [0] * n, "within": [True] * n, "form": list(range(n)),
        "ctx": [w for _, w in lines], "fk": list(range(n)), "fc": [100] * n, "mk": list(range(n)),
    })
    rows = [r for b in S._settled(table) for r in b.to_pylist()]
    return lines, {r["form"]: (r["first"], r["last"], r["key2"], r["first2"], r["last2"]) for r in rows}


def copies(draw, n, edits):
    """Lines around c of one passage, each with its own changes, some put in or left out."""
    base, out = [draw.randrange(1, 256) for _ in range(140)], []
    for _ in range(n):
        codes = [*base]
        for _ in range(draw.randrange(edits + 1)):
            at = draw.choice([k for k in range(25, 115) if abs(k - 70) > 4])
            codes[at : at + 5] = [draw.randrange(1, 256) for _ in range(draw.choice([5, 5, 4, 6]) if at > 70 else 5)]
        left, right = draw.choice([(47, 47), (20, 47), (47, 30), (1, 47), (44, 0)])
        body = codes[70 - S._SIDE : 71 + S._SIDE]
        out.append([left, right, *[v if -left <= k - S._SIDE <= right else 0 for k, v in enumerate(body)]])
    return out


def test_settled_lines_reach_as_far_as_all_pairs_do(monkeypatch):
    draw = random.Random(21)
    groups = [copies(draw, n, 3) + copies(draw, n, 2) for n in (1, 2, 5, 20, 70)]
    for small, height in ((1000, 256), (1, 64), (1, 256)):
        monkeypatch.setattr(S, "_SMALL", small)
        monkeypatch.setattr(S, "_ROWS", height)
        monkeypatch.setattr(S, "_PAIRS", 64)
        for some in ([groups] if small > 1 else [[g] for g in groups]):
            lines, got = settled(some)
            x = np.array([list(w) for _, w in lines], np.uint8)
            i, j = np.array([(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if lines[i][0] == lines[j][0]]).T
            good, mine, theirs = S._matched(x[i][:, None], x[j][:, None], np.ones((len(i), 1), bool))
            reach = np.zeros((len(x), 2), int)
            for side in (0, 1):
                np.maximum.at(reach[:, side], i, mine[side])
                np.maximum.at(reach[:, side], j, theirs[side])
            lead = S._connect(np.arange(len(x)), i[good[:, 0]], j[good[:, 0]])
            ends = [(101 - int(a), 99 + int(b)) for a, b in reach]
            assert got == {k: (*ends[k], int(lead[k]), *ends[lead[k]]) for k in range(len(x)) if reach[k, 0]}


def test_few_pairs_of_near_copies_are_verified(monkeypatch):
    draw, pairs, verified = random.Random(22), [], S._matched

    def counted(x, y, apart):
        pairs.append(apart.size)
        return verified(x, y, apart)

    monkeypatch.setattr(S, "_matched", counted)
    monkeypatch.setattr(S, "_PAIRS", 64, raising=False)
    for n in (40, 100, 300):
        pairs.clear()
        assert len(settled([copies(draw, n, 1)])[1]) > 0.5 * n
        assert sum(pairs) < 0.25 * n * (n - 1) / 2
