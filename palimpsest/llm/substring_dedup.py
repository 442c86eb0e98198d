"""Repeated passages by compact windows.

A text is its sequence of shingles (``SHINGLE`` lower-cased words).  Under a hash function, all
passages of ``LENGTH`` shingles or more whose smallest hash stands at place c, with no smaller hash
between l and r, form one compact window (l, c, r): they share c's hash as their signature.  Windows
are the wide nodes of the Cartesian tree over the hashes; there are about ``2 n / LENGTH`` of them
for n words.  ``HASHES`` functions are used, so that passages with a similarity of ``SIMILARITY``
share one nearly always, and equal passages always.

Signatures of one document alone are dropped.  The windows left carry one byte for each shingle around c; those
equal in signature, ends and bytes are one form, and all places of a form in two documents are linked to its first.

All pairs of forms of a signature that stand in different documents are verified: of some
``LENGTH`` shingles in a row, inside both windows, enough must stand in the other too for the Jaccard
similarity, in place or moved by up to ``SHIFT`` on either side of c.  Equal passages are such pairs as well.
The forms of a signature are cut into blocks of about ``BLOCK``, and each pair of blocks is
worked on by itself, so a signature of many forms is spread over many tasks and none holds more than two blocks.  Windows
too narrow for a stretch leave before, and pairs that miss too many shingles in any place of a stretch are passed over by
counting those alone, 64 pairs at once.  For the others bounds are counted of how far their stretches can reach; they are verified,
those that can reach farthest first, but for pairs of connected forms that can reach no farther than they do already.  The
pairs are not written: as all similar stretches hold c, a form needs its farthest reach on either side
and one link to the first form that similar pairs lead to.  Verified stretches of a document are merged, and those that are
linked form a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, stored
from palimpsest.llm.components import components

WORDS = 50
SHINGLE = 5
LENGTH = WORDS - SHINGLE + 1
SIMILARITY = 0.8
HASHES = 3
#: Words that may be put in or left out on either side of c; three in one place are too many for the similarity.
SHIFT = 2
#: Bits of the filter of shared signatures (32 MB at any size of the data), in parts of 64 KB.
FILTER_BITS, PART_BITS = 28, 19
#: Forms of a signature in one block, about; forms that are compared with all others at once, and pairs that are verified at once.
BLOCK = 2048
_ROWS, _PAIRS = 256, 2048
#: Forms of a small signature, at most, and of small signatures that are worked on together, about.
_SMALL, _HELD = 128, 8192
_SIDE = LENGTH - 1 + SHIFT
#: The codes of a window before c and after it, leading away from it.
_PARTS = slice(_SIDE + 1, 1, -1), slice(_SIDE + 3, None)
#: For windows that end up to ``_SIDE`` shingles before c, and after it: which places around c they hold.
_INSIDE = [(k * np.arange(-_SIDE, _SIDE + 1) <= np.arange(_SIDE + 1)[:, None]).astype(np.uint8) for k in (-1, 1)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers by multiply and shift."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _spelled(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of texts (lists of ``WORDS`` words or more) one after the other, the texts' starts, and the gaps.

    The last ``SHINGLE - 1`` places of a text begin no shingle; they are the gaps.
    """
    sizes = np.array([len(t) for t in texts])
    n, digest = int(sizes.sum()), xxhash.xxh64_intdigest
    words = np.zeros(n + SHINGLE - 1, np.uint64)
    words[:n] = np.fromiter(map(digest, chain.from_iterable(texts)), np.uint64, n)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * _M + words[k : k + n]
    stops = np.cumsum(sizes)
    gaps = (stops[:, None] - np.arange(SHINGLE - 1, 0, -1)).ravel()
    return _mixed(out), stops - sizes, gaps


def _slid(x: np.ndarray, length: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``length`` numbers in a row, by doubling."""
    width = 1
    while 2 * width <= length:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = length - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def windows(sh: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each hash function: signatures and compact windows (c, l, r) of joined texts, each of which ends in gaps."""
    inside = np.ones(len(sh), np.uint8)
    inside[gaps] = 0
    inside = _slid(inside, LENGTH, np.minimum) > 0
    pad = np.zeros(LENGTH - 1, np.uint64)
    for k in range(HASHES):
        h = _mixed(sh + np.uint64((k + 1) * int(_M) % 2**64))
        h[gaps] = np.iinfo(np.uint64).max
        least = np.where(inside, _slid(h, LENGTH, np.minimum), np.uint64(0))
        # c belongs to a wide node if it is the smallest of some stretch around it.
        c = np.flatnonzero(_slid(np.concatenate([pad, least, pad]), LENGTH, np.maximum) == h)
        # All ancestors of a wide node are wide, so the tree over the chosen places gives l and r; a gap ends all before it.
        h[gaps] = 0
        at = np.sort(np.concatenate([c, gaps]))
        values = h[at].tolist()
        places = at.tolist()
        left, right, stack = [0] * len(at), [0] * len(at), []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = places[i] - 1
            left[i] = places[stack[-1]] + 1 if stack else 0
            stack.append(i)
        own = np.searchsorted(at, c)
        yield _mixed(h[c] + np.uint64(k)), c, np.array(left, np.int64)[own], np.array(right, np.int64)[own]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and words of texts with ``WORDS`` words or more, about ``_JOIN`` words at a time."""
    keys, texts, size = [], [], 0
    for b in batches:
        for key, t in zip(b.column(0), b.column(1), strict=True):
            found = _spelled(t.as_py())
            if len(found) < WORDS:
                continue
            keys.append(key.as_py())
            texts.append(found)
            size += len(found)
            if size >= _JOIN:
                yield keys, texts
                keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _key() -> Column:
    """Names a row; rows equal in id and text count as one document."""
    return F.xxhash64("doc_id", "text").alias("key")


#: Words that are worked on at once; a longer text is by itself.
_JOIN = 100_000


def _signatures(docs: DataFrame) -> DataFrame:
    """Every document's signatures, each once, so that a count is one of documents."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _gathered(batches):
            sh, starts, gaps = joined(texts)
            sig, c = (np.concatenate(x) for x in zip(*((s, c) for s, c, *_ in windows(sh, gaps)), strict=True))
            of = np.searchsorted(starts, c, "right")
            order = np.lexsort((of, sig))
            sig, of = sig[order], of[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(sig[new].view(np.int64))], names=["sig"])

    return docs.where("text is not null").select(F.lit(0), "text").mapInArrow(made, "sig long")


def _filter(shared: DataFrame) -> np.ndarray:
    """Bit filter of the shared signatures: two bits each, of fixed size, gathered in parts."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    both = F.array(F.shiftrightunsigned("sig", 64 - FILTER_BITS), F.col("sig").bitwiseAND(mask))
    bits = shared.select(F.explode(both).alias("bit")).distinct()
    parts = bits.withColumn("part", F.shiftright("bit", PART_BITS).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        at = rows.column("bit").to_numpy() & ((1 << PART_BITS) - 1)
        raw = np.zeros(1 << PART_BITS, bool)
        raw[at] = True
        packed = np.packbits(raw, bitorder="little").tobytes()
        return pa.table({"part": rows.column("part")[:1], "bytes": pa.array([packed], pa.binary())})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    step = 1 << (PART_BITS - 3)
    for r in parts.groupBy("part").applyInArrow(pack, "part int, bytes binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bytes"], np.uint8)
    return out


def _around(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``sig, key, c, ctx`` of windows that pass the filter.

    ``ctx`` holds c - l and r - c, at most ``_SIDE``, then one byte for each shingle from
    ``c - _SIDE`` to ``c + _SIDE``: 1 to 255, 0 outside of the window.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    low = np.uint64((1 << FILTER_BITS) - 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value

        def test(at: np.ndarray) -> np.ndarray:
            return (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for keys, texts in _gathered(batches):
            sh, starts, gaps = joined(texts)
            sig, c, left, right = (np.concatenate(x) for x in zip(*windows(sh, gaps), strict=True))
            keep = test(sig >> np.uint64(64 - FILTER_BITS)) & test(sig & low)
            if not keep.any():
                continue
            sig, c = sig[keep], c[keep]
            codes = np.pad((sh % np.uint64(255) + np.uint64(1)).astype(np.uint8), _SIDE)
            ctx = np.empty((len(c), 2 * _SIDE + 3), np.uint8)
            ctx[:, 0] = np.minimum(c - left[keep], _SIDE)
            ctx[:, 1] = np.minimum(right[keep] - c, _SIDE)
            ctx[:, 2:] = np.lib.stride_tricks.sliding_window_view(codes, 2 * _SIDE + 1)[c]
            for k in (0, 1):
                ctx[:, 2:] *= _INSIDE[k][ctx[:, k]]
            of = np.searchsorted(starts, c, "right") - 1
            ends = np.arange(len(ctx) + 1, dtype=np.int32) * ctx.shape[1]
            raw = pa.Array.from_buffers(pa.binary(), len(ctx), [None, pa.py_buffer(ends), pa.py_buffer(ctx.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig.view(np.int64)), pa.array(np.array(keys, np.int64)[of]), pa.array((c - starts[of]).astype(np.int32))]
                + [raw],
                names=["sig", "key", "c", "ctx"],
            )

    return docs.where("text is not null").select(_key(), "text").mapInArrow(
        made, "sig long, key long, c int, ctx binary"
    )


def _forms(rows: DataFrame) -> DataFrame:
    """Windows equal in signature, ends and codes as one row, with their first and last place.

    ``single`` forms stand in one document only; ``twice`` are those of them with several places.
    """
    place = F.struct("key", "c")
    forms = rows.groupBy("form").agg(
        F.first("sig").alias("sig"), F.first("ctx").alias("ctx"), F.min(place).alias("f"), F.max(place).alias("m")
    )
    return forms.select(
        "form", "sig", "ctx", F.expr("f.key fk"), F.expr("f.c fc"), F.expr("m.key mk"), F.expr("m.c mc"),
        F.expr("f.key = m.key single"), F.expr("f.key = m.key and f.c <> m.c twice"),
    )


def _byte(n: int) -> Column:
    """The n-th byte of ``ctx``, from 1."""
    return F.conv(F.hex(F.substring("ctx", n, 1)), 16, 10).cast("int")


def _at_places(found: DataFrame, forms: DataFrame, places: DataFrame) -> DataFrame:
    """Links of forms at all places of the document: ``found`` names the form by its first place."""
    others = forms.where("twice").select("form", "fc").join(places, "form").where("c <> fc")
    moved = found.join(others.selectExpr("form", "c - fc move").hint("merge"), "form")
    moved = moved.withColumns({"first": F.expr("first + move"), "last": F.expr("last + move")})
    return found.select(*_SPANS).union(moved.select(*_SPANS))


def _copies(forms: DataFrame, places: DataFrame) -> DataFrame:
    """Every place of a form that stands in two documents beside its first, or its last, place."""
    shared = forms.where("not single").select("form", "fk", "fc", "mk", "mc", _byte(1).alias("xl"), _byte(2).alias("xr"))
    met = places.join(shared.hint("merge"), "form")
    own = F.col("key") == F.col("fk")
    met = met.withColumns({"key2": F.when(own, F.col("mk")).otherwise(F.col("fk")), "p": F.when(own, F.col("mc")).otherwise(F.col("fc"))})
    return met.selectExpr("key", "c - xl first", "c + xr last", "key2", "p - xl first2", "p + xr last2")


_SPANS = ["key", "first", "last", "key2", "first2", "last2"]
#: Moves before and after c; words put in or left out on both sides break too many shingles for the similarity.
_MOVES = [(0, 0)] + [(d, 0) for d in range(-SHIFT, SHIFT + 1) if d] + [(0, d) for d in range(-SHIFT, SHIFT + 1) if d]


def _needed(d: int) -> int:
    """Common shingles of stretches of ``LENGTH`` and ``LENGTH + d`` that give the similarity."""
    return int(np.ceil((2 * LENGTH + d) * SIMILARITY / (1 + SIMILARITY) - 1e-9))


_SHIFTS = range(-SHIFT, SHIFT + 1)
#: How many of the ``LENGTH`` shingles of a stretch may be missing in the other; a shorter one is such a stretch with others around it.
_MISSING = max(max(LENGTH, LENGTH + d) - _needed(d) for d in _SHIFTS)
#: As many miss only where stretches of ``LENGTH - SHIFT`` miss few; other ones miss fewer.
_SPARE = LENGTH - SHIFT - _needed(-SHIFT)
_FEWER = max(max(LENGTH, LENGTH + d) - _needed(d) for d in _SHIFTS if abs(d) < SHIFT)


def _words(table: np.ndarray) -> np.ndarray:
    """The lines of a table of truth values as bits of 64-bit numbers."""
    packed = np.packbits(table, axis=-1, bitorder="little")
    out = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def _holders(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before c and after it: which lines of y hold a code at a place that leads away from c, or up to ``SHIFT`` beside it, as bits."""
    codes, out = np.arange(1, 256, dtype=np.uint8)[:, None], []
    for part in _PARTS:
        places = np.ascontiguousarray(y[:, part].T)
        # Code 0 is no shingle: no line holds it.
        held = np.zeros((len(places), 256, -(-len(y) // 64)), np.uint64)
        for line, bits in zip(places, held, strict=True):
            bits[1:] = _words(codes == line)
        near = held.copy()
        for e in range(1, SHIFT + 1):
            near[e:] |= held[:-e]
            near[:-e] |= held[e:]
        out.append(near[: LENGTH - 1])
    return out[0], out[1]


def _reaches(a: np.ndarray, more: int) -> np.ndarray:
    """How far a window with a stretch of ``LENGTH`` can reach that has a of its shingles on this side, or ``more``; if it ends at c,
    a stretch may be longer."""
    return a + 1 + np.where(a == LENGTH - 1, SHIFT, more)


def _near(
    x: np.ndarray, y: np.ndarray, apart: np.ndarray, known: tuple[np.ndarray, ...] | None = None, holders: tuple[np.ndarray, ...] | None = None
) -> np.ndarray:
    """The pairs ``apart`` without those that miss too many shingles of x, wherever a stretch lies; loses no similar pair.

    Where it is ``known`` how x and y are connected and how far they reach, connected pairs must also be able to reach farther.
    64 pairs are counted at once: level k of a count has a bit for each pair that misses k shingles at most so far.
    """
    before, after = holders or _holders(y)
    bits = _words(apart)
    near, shape = np.zeros_like(bits), (_MISSING + 1, *bits.shape)

    def counts(held: np.ndarray, part: slice) -> Iterator[np.ndarray]:
        places = np.ascontiguousarray(x[:, part].T)
        level, some = np.full(shape, ~np.uint64(0)), np.empty((_MISSING, *bits.shape), np.uint64)
        yield level
        for lines, has in zip(places, held):
            hit = has[lines]
            np.bitwise_or(level[:-1], hit, out=some)
            level[1:] &= some
            level[0] &= hit
            yield level

    # No stretch goes on where more places than may be missing lie outside of all windows.
    most = min(LENGTH, int(x[:, 0].max(initial=0)) + _MISSING + 1)
    left = [level.copy() for _, level in zip(range(most), counts(before, _PARTS[0]))]
    a = np.arange(LENGTH)
    if known:
        lead, reach, lead2, reach2 = known
        loose = ~_words(lead[:, None] == lead2)

        def farther(w: np.ndarray, far: np.ndarray, more: int) -> np.ndarray:
            ends = np.minimum(_reaches(a, more), w[:, :1] + 1) > far[:, :1], np.minimum(_reaches(a[::-1], more), w[:, 1:2] + 1) > far[:, 1:]
            return ends[0] | ends[1]

        mine = farther(x[:, :2].astype(int), reach, 0).T
        theirs = _words(farther(y[:, :2].astype(int), reach2, SHIFT).T)
    for b, level in enumerate(counts(after, _PARTS[1])):
        k = LENGTH - 1 - b
        if k >= most:
            continue
        now = np.bitwise_or.reduce(left[k] & level[::-1], axis=0)
        if known:
            now &= np.where(mine[k][:, None], ~np.uint64(0), loose | theirs[k])
        near |= now
    near &= bits
    return np.unpackbits(near.view(np.uint8), axis=1, count=apart.shape[1], bitorder="little").view(bool)


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of x each with one of y: how far before c and after it a stretch of x, and of y, can reach at most, and how far
    both reach with stretches in place; 0 where a pair misses too many shingles."""
    counts = []
    for part in _PARTS:
        u, v = (np.ascontiguousarray(w[:, part].T) for w in (x, y))
        size, n = u.shape
        # How many of the first codes of x, of y, and of both in place are missing; a place outside of the window is.
        out = np.zeros((size + 1, 3, n), np.uint8)
        hits = np.zeros((3, size, n), bool)
        for d in _SHIFTS:
            lo, hi = max(0, -d), size - max(0, d)
            same = u[lo:hi] == v[lo + d : hi + d]
            hits[0][lo:hi] |= same
            hits[1][lo + d : hi + d] |= same
            if not d:
                hits[2] = same
        for k, w in enumerate((u, v, u)):
            np.logical_and(hits[k], w, out=hits[k])
            np.logical_not(hits[k], out=out[1:, k].view(bool))
        for i in range(size):
            np.add(out[i], out[i + 1], out=out[i + 1])
        counts.append(out)
    misses, plain = [[c[:, k] for c in counts] for k in (0, 1)], [c[:, 2] for c in counts]
    reach, far, possible = np.arange(1, LENGTH + 1, dtype=np.uint8)[:, None], [], np.ones(len(x), bool)
    back = slice(LENGTH - 1, None, -1)
    # Where a shorter stretch of x or y, within that of ``LENGTH``, misses few.
    spare = np.zeros((LENGTH, len(x)), bool)
    for left, right in misses:
        few = left[: LENGTH - SHIFT] + right[LENGTH - 1 - SHIFT :: -1] <= _SPARE
        spare[SHIFT:] |= few
        spare[: LENGTH - SHIFT] |= few
    for n, (w, (left, right)) in enumerate(zip((x, y), misses)):
        total = left[:LENGTH] + right[back]
        some = total <= _FEWER
        some |= (total <= _MISSING) & spare
        possible &= some.any(0)
        ends = [(some * reach).max(0), (some * reach[::-1]).max(0)]
        others = misses[1 - n]
        for end, (own, rest), (other, rest2) in zip(ends, ((left, right), (right, left)), (others, others[::-1])):
            # A stretch that ends at c, or soon after it, may be longer on this side than LENGTH.
            for more, d in [(m, d) for m in range(1, SHIFT + 1) for d in range(m, SHIFT + 1)]:
                b, need = d - more, _needed(d)
                longer = (other[LENGTH - 1 - b] + rest2[b] <= LENGTH - need) & (own[LENGTH - 1 + more] + rest[b] <= LENGTH + d - need)
                end[longer] = LENGTH + more
        far.append(np.minimum(np.array(ends).T, w[:, :2] + 1))
    left, right = np.minimum(x[:, :2], y[:, :2]).T
    some = plain[0][:LENGTH] + plain[1][back] <= LENGTH - _needed(0)
    some &= (reach <= left + 1) & (reach[::-1] <= right + 1)
    same = np.array([(some * reach).max(0), (some * reach[::-1]).max(0)]).T
    return far[0] * possible[:, None], far[1] * possible[:, None], same


def _hits(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``[i, d, way]`` for lines of u each with one of v, which lead away from c: how many of the first i codes of u (way 0) stand
    in v too, in place or moved by up to d, and how many of v's (way 1) stand in u."""
    u, v = (np.ascontiguousarray(w.T) for w in (u, v))
    size, n = u.shape
    out = np.zeros((size + 1, len(_SHIFTS), 2, n), np.uint8)
    hit, inside = out[1:].view(bool), u > 0
    for d in sorted(_SHIFTS, key=abs):
        lo, hi = max(0, -d), size - max(0, d)
        same = u[lo:hi] == v[lo + d : hi + d]
        same &= inside[lo:hi]
        # What a smaller move finds stays found; code j of v stands at j - d in u.
        if d:
            hit[:, d] = hit[:, d - 1 if d > 0 else d + 1]
        hit[lo:hi, d, 0] |= same
        hit[lo + d : hi + d, d, 1] |= same
    for i in range(size):
        np.add(out[i], out[i + 1], out=out[i + 1])
    return out


def _matched(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs ``apart`` are similar, and how far stretches of the windows x, and y, reach before c and after it.

    Each window of x (n, 1, bytes) is paired with one of y (n, 1, bytes).
    """
    x, y = x[:, 0], y[:, 0]
    good, reach = np.zeros(len(x), bool), np.zeros((2, 2, len(x)), np.uint8)
    left, right = (_hits(x[:, part], y[:, part]) for part in _PARTS)
    (xl, xr), (yl, yr) = x[:, :2].T, y[:, :2].T
    # Stretches of LENGTH in x beside moved ones in y, and the other way round.
    for (dl, dr), turned in [(m, t) for m in _MOVES for t in ((False, True) if any(m) else (False,))]:
        need = _needed(dl + dr)
        # Shingles before c in the first, and b after it; those of the other.
        a = np.arange(max(0, -dl), LENGTH - max(0, -dr), dtype=np.int16).astype(np.uint8)
        b = LENGTH - 1 - a
        ends = (a, b), tuple((v + np.int16(d)).astype(np.uint8) for v, d in ((a, dl), (b, dr)))
        one, two = (1, 0) if turned else (0, 1)
        el, er = (-dl, -dr) if turned else (dl, dr)
        now = apart.T
        for way, (p, q) in [(one, ends[0])] + ([(two, ends[1])] if dl or dr else []):
            p, q = slice(int(p[0]), int(p[-1]) + 1), slice(int(q[-1]), int(q[0]) + 1)
            now = now & (left[p, el, way] + right[q, er, way][::-1] >= need - 1)
        mine, theirs = ([v[:, None] for v in ends[k]] for k in (one, two))
        now &= (mine[0] <= xl) & (mine[1] <= xr)
        now &= (theirs[0] <= yl) & (theirs[1] <= yr)
        met = now.any(0)
        if not met.any():
            continue
        good |= met
        for side, far in ((reach[0], mine), (reach[1], theirs)):
            for k in (0, 1):
                np.maximum(side[k], (now * (far[k] + np.uint8(1))).max(0), out=side[k])
    return good[:, None], *reach


def _first(of: np.ndarray, far: np.ndarray, size: int) -> np.ndarray:
    """For each number of ``of``, below ``size``, a place where ``far`` is its greatest."""
    best, at = np.zeros(size, far.dtype), np.full(size, -1)
    np.maximum.at(best, of, far)
    places = np.flatnonzero(far == best[of])
    at[of[places]] = places
    return at[at >= 0]


def _compared(
    x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, known: tuple[np.ndarray, ...] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs of lines i of x and j of y are similar, and how far stretches of x, and of y, reach.

    A reach is one more than the shingles before c, and after it; 0 where there is none.  Where it is ``known`` how x and y
    are connected and how far they reach, those pairs go first that let a line reach farthest, and connected pairs that can
    reach no farther than is found by then are left out.
    """
    good, reach = np.zeros(len(i), bool), (np.zeros((len(x), 2), np.int32), np.zeros((len(y), 2), np.int32))
    parts = [_bounds(x[i[k : k + _PAIRS]], y[j[k : k + _PAIRS]]) for k in range(0, len(i), _PAIRS)]
    if not parts:
        return good, *reach
    far, far2, same = (np.concatenate(v) for v in zip(*parts))
    left = np.flatnonzero(far[:, 0])
    if known:
        lead, _, lead2, _ = known
        both = np.unique(np.concatenate([lead, lead2]), return_inverse=True)[1]
        of, of2 = both[: len(x)], both[len(x) :]
        good, reach = same[:, 0] > 0, (known[1].copy(), known[3].copy())
        for side, to in ((reach[0], i), (reach[1], j)):
            for n in (0, 1):
                np.maximum.at(side[:, n], to, same[:, n].astype(np.int32))
        group = _connect(np.arange(len(both)), of[i[good]], of2[j[good]])
    for picked in (True, False):
        now = left
        if known:
            p, q = i[left], j[left]
            gains = far[left] > reach[0][p], far2[left] > reach[1][q]
            loose = group[of[p]] != group[of2[q]]
            now = np.flatnonzero(gains[0].any(1) | gains[1].any(1) | loose)
            if picked and len(now) > _PAIRS:
                picks = []
                for to, size, ahead, gain in ((p, len(x), far[left], gains[0]), (q, len(y), far2[left], gains[1])):
                    for want, end in ((gain[:, 0], ahead[:, 0]), (gain[:, 1], ahead[:, 1]), (loose, ahead.sum(1))):
                        at = np.flatnonzero(want)
                        picks.append(at[_first(to[at], end[at], size)])
                now = np.unique(np.concatenate(picks))
            now, left = left[now], np.delete(left, now)
        for k in range(0, len(now), _PAIRS):
            at = now[k : k + _PAIRS]
            p, q = i[at], j[at]
            found, mine, theirs = _matched(x[p][:, None], y[q][:, None], np.ones((len(at), 1), bool))
            good[at] = found[:, 0]
            for side, to, ends in ((reach[0], p, mine), (reach[1], q, theirs)):
                for n in (0, 1):
                    np.maximum.at(side[:, n], to, ends[n].astype(np.int32))
        if not known:
            break
        p = now[good[now]]
        group = _connect(group, of[i[p]], of2[j[p]])
    return good, *reach


def _similar(
    x: np.ndarray, y: np.ndarray, apart: np.ndarray, known: tuple[np.ndarray, ...] | None = None, holders: tuple[np.ndarray, ...] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs ``apart`` of windows x and y are similar, and how far stretches of x, and of y, reach.

    Pairs that add nothing to what is ``known`` (see ``_compared``) may be left out.
    """
    good = np.zeros(apart.shape, bool)
    i, j = np.nonzero(_near(x, y, apart, known, holders))
    found, *reach = _compared(x, y, i, j, known)
    good[i[found], j[found]] = True
    return good, *reach


def _connect(lead: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first line that each line is connected with, once lines i and j are too."""
    while True:
        a, b = lead[i], lead[j]
        if (a == b).all():
            return lead
        np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
        while (lead != lead[lead]).any():
            lead = lead[lead]


def _blocks(forms: DataFrame) -> DataFrame:
    """Every form once for each pair of blocks that it takes part in; signatures of one document are left out.

    So are forms whose window is too narrow for any stretch, such as those at the later places of a repeated word.
    """
    forms = forms.where(_byte(1) + _byte(2) >= LENGTH - 1 - SHIFT)
    groups = forms.groupBy("sig").agg(F.count("*").alias("n"), F.min("fk").alias("lo"), F.max("mk").alias("hi"))
    groups = groups.where("n > 1 and lo <> hi").selectExpr("sig", f"int(ceil(n / {BLOCK})) blocks")
    dealt = forms.join(groups.hint("merge"), "sig").withColumn("own", F.expr("int(pmod(xxhash64(form), blocks))"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return dealt.select(F.xxhash64(pair).alias("pair"), "sig", "own", F.expr("own = other").alias("within"), "form", "ctx", "fk", "fc", "mk")


_FOUND = "form long, key long, first int, last int, key2 long, first2 int, last2 int"


def _settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a pair of blocks, or of several small signatures."""
    n = rows.num_rows
    small = np.unique(rows.column("sig").to_numpy(), return_counts=True)[1].max() <= _SMALL
    x = np.frombuffer(b"".join(rows.column("ctx").to_pylist()), np.uint8).reshape(n, -1)
    sig, own, key, key2 = (rows.column(c).to_numpy() for c in ("sig", "own", "fk", "mk"))
    within = np.array(rows.column("within"))
    reach, line, lead = np.zeros((n, 2), np.int32), np.arange(n), np.arange(n)

    def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # Forms of one document only, the same one, are no pair.
        alone = (key[i] == key2[i]) & (key[j] == key2[j]) & (key[i] == key[j])
        return ~alone & (sig[i] == sig[j]) & (within[i] | (own[i] != own[j]))

    if small:
        # Neighbours in order first, as they are often similar: what they settle leaves fewer pairs of the rest.
        stops, step = np.append(np.flatnonzero(sig[1:] != sig[:-1]), n - 1), 1
        rest = stops[np.searchsorted(stops, line)] - line
        while (rest >= step).any():
            some = line[rest >= step]
            i = np.concatenate([some[rest[some] >= r] for r in range(step, 2 * step)])
            j = i + np.repeat(np.arange(step, 2 * step), [np.count_nonzero(rest[some] >= r) for r in range(step, 2 * step)])
            full = (reach > x[:, :2]).all(1)
            at = np.flatnonzero(differ(i, j) & ~(full[i] & full[j] & (lead[i] == lead[j])))
            i, j = i[at], j[at]
            found, *ends = _compared(x, x, i, j, (lead, reach, lead, reach))
            reach = np.maximum(*ends)
            lead = _connect(lead, i[found], j[found])
            step *= 2
    else:
        before, after = _holders(x)
        for i in range(0, n, _ROWS):
            at = line[i : i + _ROWS]
            apart = differ(at[:, None], line[None]) & (at[:, None] < line)
            # The holders' bits are counted from a number's first.
            j = int(apart.any(0).argmax()) // 64
            if not apart.any():
                continue
            to, apart = line[64 * j :], apart[:, 64 * j :]
            known = lead[at], reach[at], lead[to], reach[to]
            found, mine, theirs = _similar(x[at], x[to], apart, known, (before[..., j:], after[..., j:]))
            reach[at] = np.maximum(reach[at], mine)
            reach[to] = np.maximum(reach[to], theirs)
            one, two = np.nonzero(found)
            lead = _connect(lead, at[one], to[two])
    some = np.flatnonzero(reach[:, 0])
    if len(some):
        lead, c = lead[some], rows.column("fc").to_numpy()
        form = rows.column("form").combine_chunks().take(pa.array(some))
        ends = [(c[k] - reach[k, 0] + 1, c[k] + reach[k, 1] - 1) for k in (some, lead)]
        (a, b), (a2, b2) = [[pa.array(v.astype(np.int32)) for v in e] for e in ends]
        yield pa.RecordBatch.from_arrays(
            [form, pa.array(key[some]), a, b, pa.array(key[lead]), a2, b2], names=[f.split()[0] for f in _FOUND.split(", ")]
        )


def _verified(blocks: DataFrame) -> DataFrame:
    """Each form's farthest stretch, beside the stretch of the first form that similar pairs lead to."""
    sorted_ = blocks.repartition("pair").sortWithinPartitions("pair", "own", "sig", "ctx")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, small, size, last = [], [], 0, None

        def ended(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            n = sum(b.num_rows for b in group)
            if n > _SMALL:
                yield from _settled(pa.Table.from_batches(group))
                return
            small.extend(group)
            size += n
            if size >= _HELD:
                yield from _settled(pa.Table.from_batches(small))
                small.clear()
                size = 0

        for b in batches:
            if not b.num_rows:
                continue
            group = b.column("pair").to_numpy()
            starts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if held and group[lo] != last:
                    yield from ended(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = group[lo]
        if held:
            yield from ended(held)
        if small:
            yield from _settled(pa.Table.from_batches(small))

    return sorted_.mapInArrow(check, _FOUND)


def links(docs: DataFrame) -> DataFrame:
    """Verified pairs of stretches, named as in ``_SPANS``; ends in shingle places."""
    shared = stored(_signatures(docs).groupBy("sig").count().where("count > 1").select("sig"), "signatures")
    rows = stored(_around(docs, _filter(shared)).withColumn("form", F.xxhash64("sig", "ctx")), "windows")
    forms = stored(_forms(rows), "forms")
    places = stored(rows.select("form", "key", "c"), "places")
    released(shared, rows)
    found = stored(_verified(_blocks(forms)), "links")
    good = stored(_at_places(found, forms, places).union(_copies(forms, places)), "all-links")
    released(forms, places, found)
    return good


def _merged(spans: DataFrame) -> DataFrame:
    """``key, first, last, lo, hi``: the distinct spans of each document and the merged one that holds each.

    Equal spans are dropped before they are gathered; what is gathered of a document follows its length.
    """
    each = spans.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("s"))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = b.column(1)
            sizes = np.diff(found.offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), sizes)
            first, last = (np.asarray(v, np.int64) for v in found.flatten().flatten())
            # Documents one after the other on one axis, so that one running maximum serves them all.
            base = of * (2 * (int(last.max(initial=0)) + 2))
            reach = np.maximum.accumulate(last + base)
            new = np.ones(len(of), bool)
            new[1:] = (first + base)[1:] > reach[:-1] + 1
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(of)) - 1 if len(start) else start
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of))]
                + [pa.array(v.astype(np.int32)) for v in (first, last, first[start][group], (reach - base)[stop][group])],
                names=["key", "first", "last", "lo", "hi"],
            )

    return each.mapInArrow(merge, "key long, first int, last int, lo int, hi int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop, class_id, class_size``: the repeated passages of every document.

    ``start`` and ``stop`` (exclusive) count words.  ``class_id`` is the smallest ``doc_id`` among the
    documents whose passages are linked, ``class_size`` the number of passages.  Documents without a
    passage of ``WORDS`` words that another document repeats, null and blank texts among them, have no
    row.  Rows equal in id and text count as one document and have equal rows; a null id comes last.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    met = links(docs)
    spans = met.select("key", "first", "last").union(met.select("key2", "first2", "last2"))
    span = F.xxhash64("key", "first", "last").alias("span")
    held = stored(_merged(spans).select(span, "key", "lo", "hi", F.xxhash64("key", "lo").alias("node")), "spans")
    merged = held.select("key", F.col("lo").alias("first"), F.col("hi").alias("last"), "node").distinct()

    ends = met.select(span.alias("a"), F.xxhash64("key2", "first2", "last2").alias("b")).distinct()
    for n in ("a", "b"):
        ends = ends.join(held.select(F.col("span").alias(n), F.col("node").alias(f"node_{n}")).hint("merge"), n)
    ends = stored(ends.selectExpr("node_a a", "node_b b").where("a <> b").distinct(), "passage-links")
    released(met)
    classes = components(ends)
    ids = docs.where("text is not null").select("doc_id", _key())
    named = merged.join(classes, merged.node == classes.node).select("key", "first", "last", "component")
    rows = stored(named.join(ids.hint("merge"), "key"), "named-passages")
    sizes = stored(rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
    return rows.join(sizes, "component").select(
        "doc_id", F.col("first").cast("long").alias("start"), (F.col("last") + SHINGLE).cast("long").alias("stop"), "class_id", "class_size"
    )
