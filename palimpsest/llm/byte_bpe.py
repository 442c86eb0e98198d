"""Byte-level byte-pair encoding and decoding by replaying the merges over a task's words.

Texts are cut into words by the vocabulary's pattern.  A task gathers the distinct words of the texts
it holds, lays their bytes end to end and builds an inverted index from each pair of neighbours
that some rank merges to the places where it stands.  Ranks are then applied in order, each to all its
places at once; a merge looks at its two new neighbour pairs only, and enters those into the index.
So a word that stands a million times is encoded once, and no word is scanned again after a merge.

A merge can open a pair of a lower rank only in a vocabulary that did not come from such merges; a word
where this happens is encoded by itself.  Decoding joins the bytes of the ids.

A worker remembers the ids of up to ``REMEMBERED`` pieces and takes texts in sections of about
``SECTION`` characters, cut where the pattern must cut, so memory does not grow with a text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces, and words, that a worker remembers; the memory is emptied when full.
REMEMBERED = 300_000
#: Characters of a piece or word above which it is not remembered.
LONGEST = 64
#: Characters after which a text is cut at the next certain place.
SECTION = 1 << 22

#: Blanks beyond these four send a section to the pattern whole.
_OTHER_BLANKS = regex.compile(r"[\s--[ \t\n\r]]", regex.V1)
#: A pattern's word never goes on from a character that is no blank to a blank.
_PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_CUT = regex.compile(r"(?<=\S)(?=\s)")

_ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with one token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes by the ranks of ``path``; words are the matches of ``pattern``."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = ranks_of(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._bytes = [self.ranks[bytes([b])] for b in range(256)]
        # Ranks that merge two neighbours, or -1, by their ids ``a << 32 | b``.
        self._pairs: dict[int, int] = {}
        self._pattern = regex.compile(pattern)
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def encoded(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        cut = [_pieces(t) for t in texts]
        if len(self._pieces) > REMEMBERED or len(self._words) > REMEMBERED:
            self._pieces.clear()
            self._words.clear()
        pieces, words = self._pieces, self._words
        new = {p for found in cut for p in found if p not in pieces}
        split = {p: self._pattern.findall(p) for p in new}
        fresh = {w for found in split.values() for w in found if w not in words}
        words.update(zip(fresh, self.ids([w.encode() for w in fresh]), strict=True))
        pieces.update((p, b"".join([words[w] for w in found])) for p, found in split.items())
        out = [b"".join(map(pieces.__getitem__, found)) for found in cut]
        for known, added in ((pieces, new), (words, fresh)):
            for key in added:
                if len(key) > LONGEST:
                    del known[key]
        return out

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word.  One that is a token is that token, without merges."""
        whole = [self.ranks.get(w) for w in words]
        merged = iter(self.replayed([w for w, rank in zip(words, whole, strict=True) if rank is None]))
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _rank(self, pair: int) -> int:
        """The rank that merges a pair of ids, or -1."""
        rank = self._pairs[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return rank

    def replayed(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: all merges in the order of their ranks, each at all its places."""
        starts = list(accumulate(map(len, words), initial=0))
        replay = _Replay(np.array(self._bytes, np.int64)[np.frombuffer(b"".join(words), np.uint8)], starts, self._pairs, self._rank)
        replay.run()
        kept = replay.ids >= 0
        ends = np.concatenate([[0], kept.cumsum()])[starts].tolist()
        raw = replay.ids[kept].astype("<u4").tobytes()
        out = [raw[4 * a : 4 * z] for a, z in zip(ends, ends[1:], strict=False)]
        for i in {bisect_right(starts, place) - 1 for place in replay.astray}:
            out[i] = self._alone(words[i])
        return out

    def _alone(self, word: bytes) -> bytes:
        """The ids of one word: always the leftmost pair of the lowest rank."""
        ids = [self._bytes[b] for b in word]
        while True:
            ranks = (self._rank(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False))
            best = min(((r, i) for i, r in enumerate(ranks) if r >= 0), default=None)
            if best is None:
                return np.array(ids, "<u4").tobytes()
            ids[best[1] : best[1] + 2] = [best[0]]


def _distinct(places: np.ndarray) -> np.ndarray:
    """Sorted places without repeats."""
    places.sort()
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


class _Replay:
    """Words laid end to end, with the inverted index from ranks to the places they would merge."""

    def __init__(self, ids: np.ndarray, starts: list[int], pairs: dict[int, int], learn: Callable[[int], int]) -> None:
        n = len(ids)
        self.ids, self.pairs, self.learn = ids, pairs, learn
        # The next and the last place of a token of the same word, or -1.
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edges = [(a, z - 1) for a, z in zip(starts, starts[1:], strict=False) if a < z]
        self.before[[a for a, _ in edges]] = -1
        self.after[[z for _, z in edges]] = -1
        # The rank that waits at each place for it and the next, or -1.
        self.opens = np.full(n, -1, np.int64)
        self.places: dict[int, list] = defaultdict(list)
        self.queue: list[int] = []
        self.astray: set[int] = set()
        self._enter(np.flatnonzero(self.after >= 0), -1)

    def run(self) -> None:
        """Ranks with many places come first; once they are few, plain lists are faster."""
        few = 0
        while self.queue and few < 64:
            few = few + 1 if self._merge(heapq.heappop(self.queue)) < 24 else 0
        if self.queue:
            self._run_lists()

    def _enter(self, touched: np.ndarray, now: int) -> None:
        """Looks up the pairs at the touched places and enters those that a rank merges."""
        if not len(touched):
            return
        keys = self.ids[touched] << 32 | self.ids[self.after[touched]]
        order = np.argsort(keys, kind="stable")
        keys, touched = keys[order], touched[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        kinds = keys[edges[:-1]].tolist()
        ranks = [self.pairs[p] if p in self.pairs else self.learn(p) for p in kinds]
        self.opens[touched] = np.repeat(ranks, np.diff(edges))
        groups = [touched[a:z] for a, z in zip(edges, edges[1:], strict=False)]
        for rank, group in zip(ranks, groups, strict=True):
            if rank > now:
                if rank not in self.places:
                    heapq.heappush(self.queue, rank)
                self.places[rank].append(group)
            elif rank >= 0:
                self.astray.update(group.tolist())

    def _merge(self, rank: int) -> int:
        """Applies one rank at all its places."""
        ids, after, before, opens = self.ids, self.after, self.before, self.opens
        at = _distinct(np.concatenate(self.places.pop(rank)))
        at = at[opens[at] == rank]
        if (opens[after[at]] == rank).any():
            # Pairs that share a token: the leftmost merges.
            gone: set[int] = set()
            at = np.array([i for i in at.tolist() if i not in gone and not gone.add(int(after[i]))], np.int64)
        if not len(at):
            return 0
        right, left = after[at], ids[at]
        beyond = after[right]
        ids[at], ids[right], opens[at], opens[right] = rank, -1, -1, -1
        after[at] = beyond
        on = beyond >= 0
        before[beyond[on]] = at[on]
        # Where neighbours merge at once, the right one was still as it was when the left one had merged.
        spot = np.minimum(np.searchsorted(at, beyond), len(at) - 1)
        for i, old in zip(at[at[spot] == beyond].tolist(), left[spot[at[spot] == beyond]].tolist(), strict=True):
            if 0 <= self.learn(rank << 32 | old) <= rank:
                self.astray.add(i)
        touched = _distinct(np.concatenate([at[on], before[at]]))
        self._enter(touched[touched >= 0], rank)
        return len(at)

    def _run_lists(self) -> None:
        """The same, place by place."""
        ids, after, before, opens = (x.tolist() for x in (self.ids, self.after, self.before, self.opens))
        places = {rank: np.concatenate(groups).tolist() for rank, groups in self.places.items()}
        known, learn, queue = self.pairs.get, self.learn, self.queue
        while queue:
            rank = heapq.heappop(queue)
            for i in sorted(places.pop(rank)):
                # The pair is gone if one of its two merged with another neighbour.
                if opens[i] != rank:
                    continue
                j = after[i]
                k = after[i] = after[j]
                ids[i], ids[j], opens[i], opens[j] = rank, -1, -1, -1
                if k >= 0:
                    before[k] = i
                for place in (i, before[i]):
                    if place < 0 or after[place] < 0:
                        continue
                    pair = ids[place] << 32 | ids[after[place]]
                    opened = known(pair)
                    if opened is None:
                        opened = learn(pair)
                    opens[place] = opened
                    if opened > rank:
                        if opened in places:
                            places[opened].append(place)
                        else:
                            places[opened] = [place]
                            heapq.heappush(queue, opened)
                    elif opened >= 0:
                        self.astray.add(place)
        self.ids = np.array(ids, np.int64)


def _pieces(text: str) -> list[str]:
    """Parts of a text that the pattern takes apart separately; equal parts have equal ids."""
    return [text] if _OTHER_BLANKS.search(text) else _PIECES.findall(text)


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut between a character that is no blank and a blank."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _groups(texts: list[str], size: int) -> Iterator[list[tuple[int, str]]]:
    """Sections with the number of their text, in groups of about ``size`` characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for part in sections(text, size):
            group.append((i, part))
            held += len(part)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def round_trip(docs: DataFrame, path: str, pattern: str, section: int = SECTION) -> DataFrame:
    """One row per row of ``docs``: number of tokens, and digests of the ids and of the bytes they decode to.

    Null texts are empty and have no tokens; the digests are then those of no bytes.  Ids are rows as
    they are, null or repeated.  Texts are taken whole.  Of ``docs`` only ``doc_id`` and ``text`` are
    read.  Narrow: no shuffle.
    """

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [0] * len(texts)
            digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            for group in _groups(texts, section):
                for (i, _), ids in zip(group, codec.encoded(part for _, part in group), strict=True):
                    counts[i] += len(ids) // 4
                    digests[i][0].update(ids)
                    digests[i][1].update(codec.decoded(ids))
            hexes = [[d[k].hexdigest() for d in digests] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in hexes)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(done, _ROWS)
