"""Packing of documents into token sequences by swap-based local search.

Documents are tokenised in Arrow batches, ended by an end mark and cut only where they are longer
than a sequence.  Full pieces are sequences of their own.  The others are dealt by a hash into
groups of about ``GROUP`` pieces, each packed by one task: first-come bins by best fit of falling
length, then a local search.  Its moves take the emptiest bin and exchange one document for a
shorter one, one for two shorter ones, or two for one, or move one, always into a bin at least as
full, so that the sum of squared fills rises, until the bin is empty or no move is left.  A group
loses less than one sequence against its bound as a rule, whatever the number of groups.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

LIMIT = 4096
END = 1
GROUP = 2048
#: Pieces of a bin that the local search takes two at a time, and bins in a row that it may fail to empty.  Both bound
#: its time and cost only fill: on 10,000 documents it ends at 2,005 sequences where no packing has fewer than 2,003.
PAIRED = 24
STUCK = 8
#: Whitespace-separated words whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 1_000_000
#: Texts of these characters are cut at blanks before tokenising, which the tokenizer does as well;
#: all others, and those that may hold a special token, go to it whole.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xff]*\Z")
#: The tokenizer's own split, for the letters and numbers among those characters.
_UNITS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\s0-9a-zA-Z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
)


class Encoder:
    """Token ids of texts as little-endian bytes; equal words are tokenised once per worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # Kept on an imported module, so that a reused worker finds it again.
        held = tokenizers.__dict__.setdefault("_held_encoders", {})
        if path not in held:
            held[path] = tokenizers.Tokenizer.from_file(path), {}
        self.tokenizer, self.known = held[path]

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.match(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        words = text.lower().split()
        known = self.known
        missing = [w for w in dict.fromkeys(words) if w not in known]
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = list(dict.fromkeys(words))
            self.learn(missing)
        return b"".join(map(known.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Ids of words, tokenised together as units with blanks between them."""
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            units = [_UNITS.findall(w) for w in part]
            made = self.tokenizer.encode(" ".join(itertools.chain(*units)), add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            ends = np.searchsorted(np.array(made.word_ids), np.cumsum([len(u) for u in units]))
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[w] = raw[at:end]
                at = end


_PIECES = "doc_id long, piece int, start long, length long, ids binary"
_PIECE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids``: every document's ids, cut into pieces of ``limit``.

    ``ids`` holds little-endian unsigned 32-bit numbers.  ``path`` is the tokenizer's file, found
    under the same name on every executor.  A null or empty text has the end mark alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, step = Encoder(path), np.array([end], "<u4").tobytes(), 4 * limit
        for batch in batches:
            rows, held = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + tail
                for piece, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((i, piece, at // 4, len(part) // 4, part))
                held += len(raw)
                if held > 1 << 24:
                    yield _batch(rows, _PIECE_SCHEMA)
                    rows, held = [], 0
            yield _batch(rows, _PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(parts: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``parts`` has ``length`` from 1 to ``limit``.

    Numbers are given once and written, so that lost executors cannot change the groups.  Equal
    rows are packed one by one.  Keep wide columns out of ``parts``: each row is shuffled once.
    """
    numbered = stored(parts.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    full = numbered.where(F.col("length") >= limit).select(
        *parts.columns, (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = numbered.where(F.col("length") < limit)
    groups = max(1, -(-short.count() // group))
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_uid")
        base = rows.column("_g")[0].as_py() << 32
        bins = pack_lengths(rows.column("length").to_numpy(), limit)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows.column("length").to_pylist()
        for b, members in enumerate(bins):
            at = 0
            for k in members:
                sequence[k], offset[k] = base + b, at
                at += lengths[k]
        rows = rows.select([c for c in rows.column_names if c not in ("_uid", "_g")])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = short.withColumn("_g", F.pmod(F.xxhash64("_uid"), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(pack, schema).union(full)


def pack_lengths(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins of indexes: best fit of falling length, then the local search."""
    lengths = np.asarray(lengths, np.int64)
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        at = bisect.bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([])
            room, b = limit, len(bins) - 1
        else:
            room, b = free.pop(at)
        bins[b].append(k)
        if room > size:
            bisect.insort(free, (room - size, b))
    return improved(bins, lengths, limit)


def improved(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills."""
    fills = {b: int(lengths[m].sum()) for b, m in enumerate(bins)}
    least = -(-sum(fills.values()) // limit)
    stuck: set[int] = set()
    while len(fills) > least:
        source = min((b for b in fills if b not in stuck), key=lambda b: (fills[b], b), default=None)
        if source is None:
            break
        step = _step(bins, lengths, fills, source, limit)
        if step is None:
            stuck.add(source)
            if len(stuck) > STUCK:  # the emptiest bins cannot be emptied; fuller ones can still less
                break
            continue
        out, target, back = step
        bins[source] = [k for k in bins[source] if k not in out] + back
        bins[target] = [k for k in bins[target] if k not in back] + out
        change = int(lengths[out].sum()) - int(lengths[back].sum() if back else 0)
        fills[source] -= change
        fills[target] += change
        stuck.clear()
        if not bins[source]:
            del fills[source]
    return [bins[b] for b in sorted(fills)]


def _step(bins: list[list[int]], lengths: np.ndarray, fills: dict[int, int], source: int, limit: int):
    """The change (documents out of ``source``, target, documents back) that fills a bin best."""
    others = [b for b in fills if b != source and fills[b] < limit and fills[b] >= fills[source]]
    if not others:
        return None
    room = np.array([limit - fills[b] for b in others])
    single = [(i, k) for i, b in enumerate(others) for k in bins[b]]
    pairs = [(i, k, j) for i, b in enumerate(others) for k, j in itertools.combinations(bins[b][:PAIRED], 2)]
    single_a, pairs_a = np.array(single), np.array(pairs or np.zeros((0, 3), int))
    single_len = lengths[single_a[:, 1]]
    pairs_len = lengths[pairs_a[:, 1]] + lengths[pairs_a[:, 2]]
    best, found = None, None

    def consider(out: list[int], gain: np.ndarray, at: np.ndarray, back) -> None:
        """gain: what each choice adds to its target; kept is the one that leaves least room."""
        nonlocal best, found
        fits = (gain > 0) & (gain <= room[at])
        if not fits.any():
            return
        left = np.where(fits, room[at] - gain, limit + 1)
        k = int(left.argmin())
        score = (int(left[k]), -int(gain[k]))
        if best is None or score < best:
            best, found = score, (out, others[int(at[k])], back(k))

    mine = bins[source]
    every = np.arange(len(others))
    for k in mine:
        size = int(lengths[k])
        consider([k], np.full(len(others), size), every, lambda _: [])
    if found:  # a plain move needs no exchange
        return found
    for k in mine:
        size = int(lengths[k])
        consider([k], size - single_len, single_a[:, 0], lambda c: [single[c][1]])
        if len(pairs):
            consider([k], size - pairs_len, pairs_a[:, 0], lambda c: list(pairs[c][1:]))
    for a, b in itertools.combinations(mine[:PAIRED], 2):
        consider([a, b], int(lengths[a] + lengths[b]) - single_len, single_a[:, 0], lambda c: [single[c][1]])
    return found
