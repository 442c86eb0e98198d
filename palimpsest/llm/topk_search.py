"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component that gives all of them the same length M, so the largest inner
products with a query are its nearest neighbours, and the triangle inequality holds.  Every vector
is keyed by its nearest pivot, of about the square root of their number, and its distance from it;
a pivot's distances are cut by rank into rings (annuli).  Of each annulus the least and largest
distance from its own pivot and from up to ``REFERENCES`` pivots is known, and each of them bounds the
distance of a query from all vectors inside.  A query first meets the annuli with the best bounds,
which gives it a k-th best score, and then only those that no bound rules out.

Pivots come from at most ``SAMPLE`` vectors by a few rounds of k-means, every vector is indexed.  Small annuli
share a block, large ones are dealt into several by a hash of the id, so one vector repeated in a
third of all rows fills many blocks; queries come in chunks.  A task holds one block and one chunk, and a
block goes only to chunks of which a query asks for it.  Scores are whole numbers computed
without rounding, so the result does not depend on pivots or rings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import stored

K = 20
SCALE = 64
#: Vectors that pivots are chosen from, at most; pivots, rings of each, and pivots that bound every annulus, at most.
SAMPLE = 8192
PIVOTS = 1024
RINGS = 16
REFERENCES = 64
#: Rows that a ring shall have at least, rows of a block and queries of a chunk, at most on average.
RING_ROWS = 32
BLOCK = 16384
CHUNK = 2048
#: Scores that a task holds at a time, about.
HELD = 1 << 20


def whole_vectors(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: every component floored after scaling.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(F.col(ident).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(ident).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lifted(rows: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.maximum(0.0, m2 - (rows**2).sum(1)))[:, None]])


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(gap, 0.0))


def chosen_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Pivots by k-means over the sample, started from rows far from each other."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    pivots = sample[picked].copy()
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(1)
        for j in range(len(pivots)):
            if (near == j).any():
                pivots[j] = sample[near == j].mean(0)
    return pivots


def _keyed(vectors: DataFrame, pivots: np.ndarray, m2: float, width: int) -> DataFrame:
    """``vec_id, v, pivot, dist``."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = _distances(_lifted(_matrix(b.column(1), width), m2), pivots)
            near = gap.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(gap[np.arange(len(near)), near])],
                names=["vec_id", "v", "pivot", "dist"],
            )

    return vectors.mapInArrow(key, "vec_id long, v array<long>, pivot int, dist double")


_HITS = "query_id long, vec_id long, score long"
_ASKS = "query_id long, q array<long>, chunk int, block int, annuli array<int>"


def _best(queries: pa.Table, block: pa.Table, k: int, width: int) -> pa.Table:
    """The k best of a block's annuli for each query that asks for them, ties to the smaller id; its own id is left out."""
    order = np.argsort(block.column("vec_id").to_numpy(), kind="stable")
    order = order[np.argsort(block.column("annulus").to_numpy()[order], kind="stable")]
    ids, rows = block.column("vec_id").to_numpy()[order], _matrix(block.column("v"), width)[order]
    annuli, starts = np.unique(block.column("annulus").to_numpy()[order], return_index=True)
    ends = np.append(starts[1:], len(ids))
    asked, asks = queries.column("query_id").to_numpy(), _matrix(queries.column("q"), width)
    wanted = queries.column("annuli").combine_chunks()
    of_query = np.repeat(np.arange(len(asked)), np.diff(wanted.offsets.to_numpy()))
    wanted = wanted.flatten().to_numpy()
    # Sums below 2**53 are exact as doubles; larger components are multiplied as integers.
    if len(rows) and len(asks) and np.abs(rows).max() * np.abs(asks).max() * max(1, width) >= 2.0**53:
        rows, asks = rows.astype(np.int64), asks.astype(np.int64)
    lowest = np.iinfo(np.int64).min
    # The k-th best score so far of each query; whatever is below it can no longer be among the k best.
    floor = np.full(len(asked), lowest + 1)
    empty = np.zeros(0, np.int64)
    kept, hits, held = (empty, empty, empty), [], 0

    def best_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, found, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        floor[query[place == k - 1]] = score[place == k - 1]
        return query[place < k], found[place < k], score[place < k]

    for annulus, start, end in zip(annuli.tolist(), starts.tolist(), ends.tolist(), strict=True):
        who = of_query[wanted == annulus]
        step = max(1, HELD // (end - start))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            scores = (asks[some] @ rows[start:end].T).astype(np.int64)
            scores[asked[some, None] == ids[None, start:end]] = lowest
            query, row = np.nonzero(scores >= floor[some, None])
            hits.append((some[query], ids[start + row], scores[query, row]))
            held += len(row)
            if held > HELD:
                kept, hits, held = best_of([kept, *hits]), [], 0
    query, found, score = best_of([kept, *hits])
    return pa.table([pa.array(c, pa.int64()) for c in (asked[query], found, score)], names=["query_id", "vec_id", "score"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Annuli:
    """What is known of the annuli; the arrays have at most PIVOTS * RINGS rows."""

    width: int
    m2: float
    pivots: np.ndarray
    references: np.ndarray
    owner: np.ndarray
    #: Least and largest distance from the own pivot (first column) and the reference pivots.
    lo: np.ndarray
    hi: np.ndarray
    sizes: np.ndarray
    #: First block of each annulus and the number of its blocks.
    block: np.ndarray
    blocks: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every query with the vectors of every annulus."""
        gap = _distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots)
        least = np.zeros((len(q), len(self.owner)))
        for j, to in enumerate([gap[:, self.owner], *(gap[:, [r]] for r in self.references.tolist())]):
            np.maximum(least, np.maximum(self.lo[:, j] - to, to - self.hi[:, j]) - 1e-6 * (1 + to), out=least)
        return np.where(self.sizes > 0, ((q**2).sum(1)[:, None] + self.m2 - least**2) / 2 + 1e-6 * (1 + self.m2), -np.inf)


def indexed(vectors: DataFrame) -> tuple[DataFrame, Annuli] | None:
    """``vectors(vec_id, v)``, a table that does not change, by annulus and block, and the annuli; None for an empty one."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    total, width, m2 = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not total:
        return None
    width = max(1, width)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    pivots = chosen_pivots(_lifted(_matrix(sample.column("v"), width), m2), max(1, min(PIVOTS, int(total**0.5))))
    count = len(pivots)
    rings = max(1, min(RINGS, total // (count * RING_ROWS)))
    references = np.unique(np.linspace(0, count - 1, min(REFERENCES, count)).astype(int))

    # Ring limits by rank, from counts of fine distance steps, at most 1024 for each pivot.
    fine = max(1e-9, 2 * m2**0.5) / 1024
    keyed = stored(_keyed(vectors, pivots, m2, width), "pivot-distances").withColumn("f", F.floor(F.col("dist") / fine).cast("int"))
    steps = keyed.groupBy("pivot", "f").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("f")) - F.col("n")
    share = F.sum("n").over(Window.partitionBy("pivot")) / rings
    ring = F.least(F.floor(before / share), F.lit(rings - 1)).cast("int")
    steps = stored(steps.select("pivot", "f", "n", (F.col("pivot") * rings + ring).alias("annulus")), "distance-steps")
    annuli = count * rings
    sizes = np.zeros(annuli, np.int64)
    for r in steps.groupBy("annulus").agg(F.sum("n").alias("n")).collect():
        sizes[r["annulus"]] = r["n"]
    # Large annuli have blocks of their own; the others fill blocks in the order of their pivots.
    blocks = np.maximum(1, -(-sizes // BLOCK))
    small = np.where(blocks == 1, sizes, 0)
    shared = np.cumsum(small) // BLOCK
    own = np.cumsum(np.where(blocks > 1, blocks, 0)) - np.where(blocks > 1, blocks, 0)
    block = np.where(blocks > 1, shared[-1] + 1 + own, shared)
    # At most PIVOTS * 1024 rows, hence the broadcast.
    placed = keyed.join(F.broadcast(steps.select("pivot", "f", "annulus")), ["pivot", "f"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            annulus, salt = b.column("annulus").to_numpy(), b.column("salt").to_numpy()
            at = block[annulus] + salt % blocks[annulus]
            yield pa.RecordBatch.from_arrays([*b.select(["vec_id", "v", "annulus"]).columns, pa.array(at, pa.int32())], names=["vec_id", "v", "annulus", "block"])

    salted = placed.select("vec_id", "v", "annulus", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)).alias("salt"))
    rows = stored(salted.mapInArrow(dealt, "vec_id long, v array<long>, annulus int, block int"), "annuli")
    owner = np.repeat(np.arange(count), rings)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distances of the annuli of a task."""
        lo = np.full((annuli, 1 + len(references)), np.inf)
        hi = np.full(lo.shape, -np.inf)
        for b in batches:
            gap = _distances(_lifted(_matrix(b.column("v"), width), m2), pivots)
            annulus = b.column("annulus").to_numpy()
            gap = np.hstack([gap[np.arange(len(annulus)), owner[annulus]][:, None], gap[:, references]])
            np.minimum.at(lo, annulus, gap)
            np.maximum.at(hi, annulus, gap)
        met = np.flatnonzero(hi[:, 0] >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(lo[met].tolist(), pa.list_(pa.float64())), pa.array(hi[met].tolist(), pa.list_(pa.float64()))], names=["annulus", "lo", "hi"])

    def joined(group: pa.Table) -> pa.Table:
        lo, hi = (np.array(group.column(c).to_pylist()) for c in ("lo", "hi"))
        return pa.table({"annulus": group.column("annulus")[:1], "lo": pa.array([lo.min(0).tolist()]), "hi": pa.array([hi.max(0).tolist()])})

    shape = "annulus int, lo array<double>, hi array<double>"
    limits = rows.select("v", "annulus").mapInArrow(ranges, shape).groupBy("annulus").applyInArrow(joined, shape).toArrow()
    lo = np.zeros((annuli, 1 + len(references)))
    hi = np.zeros_like(lo)
    at = limits.column("annulus").to_numpy()
    if len(at):
        lo[at], hi[at] = (np.array(limits.column(c).to_pylist()) for c in ("lo", "hi"))
    return rows, Annuli(width, m2, pivots, references, owner, lo, hi, sizes, block, blocks)


def asks(annuli: Annuli, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """Which annuli ``queries(query_id, q, chunk, least)`` ask for, by block: the best ones, or those left that may beat ``least``."""
    sizes, block, blocks = annuli.sizes, annuli.block, annuli.blocks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // len(sizes))
        for b in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            bound = annuli.bounds(_matrix(b.column("q"), annuli.width))
            order = np.argsort(-bound, axis=1, kind="stable")
            # First come the best annuli until they hold eight times k rows.
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order, held < 8 * k, axis=1)
            if first:
                keep = early & (sizes > 0)
            else:
                least = np.array([-np.inf if t is None else float(t) for t in b.column("least").to_pylist()])
                keep = ~early & (sizes > 0) & (bound >= least[:, None])
            at, annulus = np.nonzero(keep)
            times = blocks[annulus]
            at, annulus, n = np.repeat(at, times), np.repeat(annulus, times), np.arange(times.sum())
            to = block[annulus] + n - np.repeat(np.cumsum(times) - times, times)
            # One row for each query and block, with the annuli it asks for there.
            order = np.lexsort((annulus, to, at))
            at, annulus, to = at[order], annulus[order], to[order]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (to[1:] != to[:-1])])) if len(at) else np.zeros(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(annulus, pa.int32()))
            picked = b.select(["query_id", "q", "chunk"]).take(pa.array(at[new]))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(to[new], pa.int32()), lists], names=["query_id", "q", "chunk", "block", "annuli"])

    return queries.mapInArrow(ask, _ASKS)


def _answered(rows: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """The best hits of the asked annuli; a block is copied to the chunks that ask for it."""
    wanted = asked.select("block", F.col("chunk").alias("to_chunk")).distinct()
    each = rows.join(wanted, "block")
    met = asked.groupBy("block", "chunk").cogroup(each.groupBy("block", "to_chunk"))
    return met.applyInArrow(lambda q, b: _best(q, b, k, width), _HITS)


def chunked(queries: DataFrame) -> DataFrame:
    """Queries with the chunk they are asked in."""
    chunks = max(1, -(-queries.count() // CHUNK))
    return queries.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(chunks)).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, v)`` that ``is_query`` names.

    Vectors of different lengths count as filled up with zeros.  Ids are expected to be unique: of
    several queries with one id the smallest vector is asked, rows with a query's id are not its
    candidates, and an id that occurs twice may be found twice.  Fewer candidates than ``k`` are
    all returned; a query without any has no row.
    """
    vectors = stored(vectors, "vectors")
    index = indexed(vectors)
    if not index:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")
    queries = chunked(stored(queries, "queries"))
    rows, annuli = index
    early = stored(_answered(rows, stored(asks(annuli, queries, k, True), "early-asks"), k, annuli.width), "early-hits")
    least = _ranked(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    late = stored(asks(annuli, queries.join(least, "query_id", "left"), k, False), "late-asks")
    return _ranked(early.union(_answered(rows, late, k, annuli.width)), k).select("query_id", "rank", "vec_id", "score")
