"""Near-duplicate documents by SimHash fingerprints and segment popcounts.

A fingerprint is embedded as the bit counts of its 2-bit segments.  One differing bit changes
one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints.  Links of at most three bits are therefore found among points
within Manhattan distance three: the 32 counts are cut into two halves, and one half differs
by at most one.  Each half spans a grid of unit cells; every fingerprint is stored under its
own cell and asks for that cell and those with one count raised.  Candidates pass the bound
over the totals of both halves and are then compared exactly.  No link is missed.

Copies share a fingerprint and enter the search once, so a group of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import row_key, stored
from palimpsest.llm.components import components

#: Fingerprints link at this many differing bits or fewer; the two-half search is made for it.
MAX_BITS = 3
SHINGLE = 3
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EVEN = 0x55555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < shingle:
        parts = [b" ".join(found)]
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, seed) for p in parts], dtype="<u8")
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        rows = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Column of signed 64-bit fingerprints."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64")

    return of(docs[text])


def links(nodes: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints in ``nodes(fp)`` within three bits."""
    halves = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    points = nodes.select("fp", F.bit_count(halves[0]).alias("lo"), F.bit_count(halves[1]).alias("hi"))
    counts = [h.bitwiseAND(F.lit(_EVEN)) + F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(_EVEN)) for h in halves]
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("half"), c.alias("cell")) for i, c in enumerate(counts))))
    stored_at = points.select("*", half.alias("k")).select("fp", "lo", "hi", "k.*")
    # A segment's count is two bits wide; 2 + 1 is the code 3, which no fingerprint has.
    steps = F.array(F.lit(0).cast("long"), *(F.lit(1 << (2 * i)).cast("long") for i in range(16)))
    asks = stored_at.select(
        F.col("fp").alias("fp2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "half",
        F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("cell"),
    )
    near = F.abs(F.col("lo") - F.col("lo2")) + F.abs(F.col("hi") - F.col("hi2")) <= MAX_BITS
    exact = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS
    met = asks.join(stored_at, ["half", "cell"]).where(near & exact & (F.col("fp") != F.col("fp2")))
    return met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def classes(marked: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of ``marked(fp, ident)``.

    ``component_id`` is the smallest ``ident`` of all documents whose fingerprints are reachable
    by links; null where all of them have a null ``ident``.
    """
    low = F.min(F.col(ident))
    nodes = stored(marked.groupBy("fp").agg(low.alias("low")), "nodes")
    joined = stored(components(links(nodes)), "components")
    named = nodes.join(joined, nodes.fp == joined.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    # A component holds distinct fingerprints only; their minimum is aggregated before the shuffle.
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    return stored(named.join(lowest, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows and equal
    ids give one output row each.  A null id never names a component.  Other columns are ignored.
    """
    marked = stored(docs.select(F.col(ident).alias("doc_id"), fingerprints(docs, text).alias("fp")), "fingerprints")
    return marked.join(classes(marked), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates of documents with smaller ids; same columns.

    Of each component the document with the smallest id stays (null ids come last, equal ids in
    the order of a hash of the text); of rows equal in id and text one stays.
    """
    marked = stored(docs.select(row_key().alias("key"), fingerprints(docs).alias("fp")), "fingerprints")
    # Any number that is the same for the same component serves as its name here.
    roots = classes(marked.select("fp"), "fp")
    order = F.struct(F.col("key.id").isNull().alias("none"), "key.id", "key.h")
    first = marked.join(roots, "fp").groupBy("component_id").agg(F.min(order).alias("o")).select("o.id", "o.h")
    copies = marked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key.*", "n")
    copies = copies.toDF("id2", "h2", "n")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    first = stored(first.join(copies, same, "left").select("id", "h", "n"), "first")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h2"))
    kept = rows.join(first.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("h2") == F.col("h")))
    once = kept.where("n is not null").dropDuplicates(["id", "h"])
    return kept.where("n is null").select("row.*").union(once.select("row.*"))
