"""Periodic runs of words, found online by catchers over power-of-two blocks.

Words are appended to a ``Catchers``.  Every completed block of ``b = 2, 4, 8, ...`` words that starts
at a multiple of ``b`` has a catcher, which waits for the block to come back at the distances that
its size is meant for: words that repeat with period ``q`` agree with the words ``q`` further on for
``max(q, shortest - q)`` places or more, and so many places always hold a whole block of the largest
``b`` with ``2 * b - 1`` places or fewer.  The suffix of ``b`` words at each appended word has a hash,
made of two hashes of half the size, and meets those of the catchers.  A block that came back is
extended to the left by comparing words, and to the right with the words there are; what reaches the
last word stays open and goes on with the next append.  An extension of ``2 * q`` words holds a
square, all squares of one stretch merge into one run, and a stretch whose period is a multiple of a
smaller one is no run of its own.

Any number of words may be appended at a time: NumPy compares all of them with all waiting catchers
at once, with 2 comparisons for each word and size.  What is kept is the words and, for each
size, the hashes that catchers still wait on, so memory grows with the text and not with the sizes.
Hashes only propose; every run is made of words that were compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run.
SHORTEST = 12
#: Words appended at a time.
CHUNK = 1 << 16

Run = tuple[int, int, int]

_ROWS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, with multiplications, xors and shifts on 64 bits."""
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0xD1B54A32D192ED03))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Catchers:
    """The runs of a sequence of whole numbers that is appended to."""

    def __init__(self, shortest: int = SHORTEST) -> None:
        self.shortest = shortest
        self.n = 0
        self._words = np.empty(0, np.int64)
        # By size: the first place whose suffix hash is kept, and the hashes from there.
        self._hashes: dict[int, tuple[int, np.ndarray]] = {1: (0, np.empty(0, np.uint64))}
        # By size: the distances that its catchers wait for, and the place up to which they have looked.
        self._spans: dict[int, list[tuple[int, int]]] = {}
        self._looked: dict[int, int] = {}
        self._runs: list[Run] = []
        # Stretches ``(start, end, period)`` that reach the last word, squares or not yet.
        self._open: list[Run] = []
        # By period: the last stretch that this append went on with or found.
        self._last: dict[int, tuple[int, int]] = {}

    def append(self, words: np.ndarray) -> None:
        """Appends words, any number of them."""
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self._words):
            grown = np.empty(2 * self.n if before else self.n, np.int64)
            grown[:before] = self._words[:before]
            self._words = grown
        self._words[before : self.n] = words
        waiting, self._open, self._last = self._open, [], {}
        for start, end, q in waiting:
            self._settle(start, self._ahead(end, q), q)
        self._hash_up()
        for b in self._spans:
            self._catch(b)
        for b, (first, hashes) in self._hashes.items():
            keep = 8 * max(b, self.shortest)
            if len(hashes) > 2 * keep:
                self._hashes[b] = (first + len(hashes) - keep, hashes[-keep:].copy())

    def runs(self) -> list[Run]:
        """The runs so far as ``(start, length, period)``, by start and period."""
        return sorted((start, end - start, q) for start, end, q in self._squares())

    def _squares(self, below: int | None = None) -> list[Run]:
        """Runs so far as ``(start, end, period)``, open ones included, of periods under ``below``.

        Stretches that also repeat with a divisor of their period have the same ends for both.
        """
        least: dict[tuple[int, int], int] = {}
        for start, end, q in self._runs + [r for r in self._open if self._is_square(*r)]:
            if below is None or q < below:
                least[start, end] = min(q, least.get((start, end), q))
        return [(*ends, q) for ends, q in least.items()]

    def _size(self, q: int) -> int:
        """Size of the blocks of which a repetition of period ``q`` always holds one."""
        return 1 << ((max(q, self.shortest - q) + 1) // 2).bit_length() - 1

    def _distances(self, b: int) -> list[tuple[int, int]]:
        if 2 * b - 1 >= self.shortest:
            return [(2 * b - 1, 4 * b - 1)]
        spans: list[tuple[int, int]] = []
        for q in (q for q in range(1, 4 * b - 1) if self._size(q) == b):
            if spans and spans[-1][1] == q:
                spans[-1] = (spans[-1][0], q + 1)
            else:
                spans.append((q, q + 1))
        return spans

    def _hash_up(self) -> None:
        """Suffix hashes of the new places, size by size, for periods up to half the words."""
        first, old = self._hashes[1]
        new = self._words[first + len(old) : self.n].astype(np.uint64)
        self._hashes[1] = (first, np.concatenate([old, _mixed(new, new)]))
        b = 1
        while self.n >= self.shortest and (2 * b - 1 < self.shortest or self.n >= 4 * b - 2):
            if b > 1:
                half_first, half = self._hashes[b // 2]
                first, old = self._hashes.get(b, (b - 1, np.empty(0, np.uint64)))
                at = first + len(old) - half_first
                self._hashes[b] = (first, np.concatenate([old, _mixed(half[at - b // 2 : len(half) - b // 2], half[at:])]))
            if b not in self._spans:
                self._spans[b], self._looked[b] = self._distances(b), 0
            b *= 2

    def _catch(self, b: int) -> None:
        """Compares the suffixes at the places not yet looked at with the blocks of size ``b`` before them."""
        first, hashes = self._hashes[b]
        looked, self._looked[b] = self._looked[b], self.n
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in self._spans[b]:
            # Ends of blocks with a distance among the new places; most have all of theirs there.
            ends = np.arange(max(1, -(-(looked - high + 2) // b)) * b - 1, self.n - low, b)
            whole = (ends + low >= looked) & (ends + high <= self.n)
            for end in ends[~whole].tolist():
                a, z = max(end + low, looked), min(end + high, self.n)
                at = np.flatnonzero(hashes[a - first : z - first] == hashes[end - first])
                if len(at):
                    met.append((np.full(len(at), end), at + a))
            ends = ends[whole]
            if len(ends):
                windows = np.lib.stride_tricks.sliding_window_view(hashes, high - low)[ends[0] + low - first :: b][: len(ends)]
                row, column = np.nonzero(windows == hashes[ends - first][:, None])
                if len(row):
                    met.append((ends[row], ends[row] + low + column))
        if met:
            ends, places = (np.concatenate(x) for x in zip(*met, strict=True))
            order = np.argsort(places, kind="stable")
            self._extend(b, ends[order], places[order])

    def _extend(self, b: int, ends: np.ndarray, places: np.ndarray) -> None:
        """Extends the blocks that came back, once for each stretch of one period."""
        new = self._outside(b, ends, places)
        for end, place in zip(ends[new].tolist(), places[new].tolist(), strict=True):
            q = place - end
            start, stop = self._last.get(q, (0, 0))
            if start <= end - b + 1 and place < stop:
                continue
            self._settle(self._back(end - b + 1, q), self._ahead(place + 1, q), q)

    def _outside(self, b: int, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Marks what is not just a multiple of a shorter period inside one of its runs.

        Two runs of periods under ``b`` share fewer than ``2 * b`` words, so at most one holds block and
        suffix, and it is the one that reaches furthest of those that start no later.
        """
        known = sorted(self._squares(b))
        if not known:
            return np.ones(len(ends), bool)
        starts, stops, periods = np.array(known).T
        furthest = np.maximum.accumulate(stops)
        best = np.maximum.accumulate(np.where(stops == furthest, np.arange(len(stops)), 0))
        at = np.searchsorted(starts, ends - b + 1, side="right") - 1
        run = best[np.maximum(at, 0)]
        return (at < 0) | (places >= stops[run]) | ((places - ends) % periods[run] != 0)

    def _settle(self, start: int, end: int, q: int) -> None:
        """Keeps a stretch open if it reaches the last word, and reports it if it ended as a square."""
        self._last[q] = (start, end)
        if end == self.n:
            self._open.append((start, end, q))
        elif self._is_square(start, end, q):
            self._runs.append((start, end, q))

    def _is_square(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.shortest, 2 * q)

    def _ahead(self, place: int, q: int) -> int:
        """The first place from ``place`` that differs from the one ``q`` before it."""
        step = 16
        while place < self.n:
            stop = min(place + step, self.n)
            other = np.flatnonzero(self._words[place:stop] != self._words[place - q : stop - q])
            if len(other):
                return place + int(other[0])
            place, step = stop, 4 * step
        return self.n

    def _back(self, place: int, q: int) -> int:
        """The first place from which all up to ``place`` agree with the ones ``q`` after them."""
        step = 16
        while place > 0:
            start = max(place - step, 0)
            other = np.flatnonzero(self._words[start:place] != self._words[start + q : place + q])
            if len(other):
                return start + int(other[-1]) + 1
            place, step = start, 4 * step
        return 0


def runs_of(words: list[bytes], shortest: int = SHORTEST, chunk: int = CHUNK) -> list[Run]:
    """All runs ``(start, length, period)`` of a list of words, by start and period."""
    codes: dict[bytes, int] = {}
    numbers = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    catchers = Catchers(shortest)
    # Without a word that comes back there is nothing to catch.
    if len(codes) < len(words):
        for i in range(0, len(numbers), chunk):
            catchers.append(numbers[i : i + chunk])
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    starts, lengths, periods = np.array(runs).T
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts + periods, 1)
    np.add.at(edge, starts + lengths, -1)
    return [words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0).tolist()]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a planted repetition: for a tenth of all ids, the end is filled with copies of one stretch."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _row(doc_id: int | None, words: list[bytes], shortest: int) -> tuple:
    runs = runs_of(words, shortest)
    listed = hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, listed, kept


def detected(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``docs``: its number of runs, the longest one, and digests of all runs and of the words left.

    The longest run is the first of equals by start, then period; without a run it is null.
    ``plant`` rewrites a tenth of the documents by ``looped`` first.  Null and blank texts have no
    words and no runs; repeated ids are rows of their own; a null id is never planted; texts are
    taken whole.  Of ``docs`` only ``doc_id`` and ``text`` are read.  Narrow: no shuffle.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").split()
                rows.append(_row(doc_id, looped(doc_id, words) if plant else words, shortest))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, _ROWS)
