"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Texts become 64-bit fingerprints. Two fingerprints with at most two differing bits agree in one of
three blocks of bits, and in one of three blocks of what is left; so each fingerprint goes to nine
keys of about 36 bits, and every linked pair meets under one of them. Within a task the
fingerprints of a key are sorted by Gray rank, which puts those with long common bit patterns side
by side; upper nodes of a tree hold the bits that all rows below share and the node above does not,
and a search adds up differences on the way down and drops a whole group once they pass the limit.

Only rows (key, fingerprint) of distinct fingerprints are shuffled, never texts or copies; a task
reports the links that join two of its groups, so a dense group gives fewer links than it has rows.
A task holds 16 bytes for each of its fingerprints; at most 2^28 can share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rolesieve.llm.common import n_partitions, stored
from rolesieve.llm.components import components

SEED, WORDS, LIMIT = 42, 3, 2
#: Rows of a leaf, and children of a node.
LEAF, FANOUT = 16, 16
#: Fingerprints of one search step; bounds its memory.
STEP = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of one text as an unsigned number; null and texts without words give 0."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else (b" ".join(parts),)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    for i in range(0, n, STEP):
        bits = np.unpackbits(hashes[i:i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _masks() -> list[int]:
    """The nine sets of bits of which a linked pair agrees in at least one."""
    out = []
    for block in np.array_split(np.arange(64), 3):
        rest = np.setdiff1d(np.arange(64), block)
        out += [sum(1 << int(b) for b in (*block, *part)) for part in np.array_split(rest, 3)]
    return out


MASKS = _masks()


class GrayTree:
    """Index over codes that are sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        ones, zeros = self._reduce(codes, ~codes, LEAF)
        levels = [(ones, zeros)]
        while len(levels[-1][0]) > 1:
            levels.append(self._reduce(*levels[-1], FANOUT))
        self.levels = []  # root first: bits that a node adds to the node above, and their values
        above = None
        for ones, zeros in reversed(levels):
            fixed = ones | zeros
            own = fixed if above is None else fixed & ~np.repeat(above, FANOUT)[:len(fixed)]
            self.levels.append((own, ones & own))
            above = fixed
        self.left = ~np.repeat(above, LEAF)[:len(codes)]  # bits that no node above a row has

    @staticmethod
    def _reduce(ones, zeros, width):
        at = np.arange(0, len(ones), width)
        return np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)

    def pairs(self, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of all rows with at most ``limit`` differing bits."""
        n = len(self.codes)
        for start in range(0, n, STEP):
            i = np.arange(start, min(n, start + STEP))
            node, seen = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for depth, (mask, value) in enumerate(self.levels):
                if depth:
                    i, node, seen = self._below(i, node, seen, FANOUT, len(mask))
                # a node whose rows all stand before i would only repeat pairs
                span = LEAF * FANOUT ** (len(self.levels) - 1 - depth)
                seen = seen + np.bitwise_count((self.codes[i] ^ value[node]) & mask[node])
                keep = (seen <= limit) & ((node + 1) * span > i)
                i, node, seen = i[keep], node[keep], seen[keep]
            for part in range(0, len(i), STEP):
                at = slice(part, part + STEP)
                a, b, d = self._below(i[at], node[at], seen[at], LEAF, n)
                keep = (b > a) & (d + np.bitwise_count((self.codes[a] ^ self.codes[b]) & self.left[b]) <= limit)
                yield a[keep], b[keep]

    @staticmethod
    def _below(i, node, seen, width, n):
        child = (node[:, None] * width + np.arange(width)).ravel()
        keep = child < n
        return np.repeat(i, width)[keep], child[keep], np.repeat(seen, width)[keep]


class Forest:
    """Union-find over positions that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.parent, self.a, self.b = np.arange(n), [], []

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            higher = self.parent[up]
            if (higher == up).all():
                self.parent[x] = up
                return up
            up = higher

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            new = ra != rb
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)  # each root gets one new parent a round
            self.parent[high[first]] = low[first]
            self.a.append(a[first])
            self.b.append(b[first])


def forest_links(keys: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes of equal keys, as many as join all that can be joined."""
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    forest = Forest(len(codes))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(keys)])
    for step in range(1, LEAF):  # all groups of one leaf at once
        i = np.arange(len(codes) - step)
        i = i[(np.repeat(sizes, sizes)[i] <= LEAF) & (keys[i] == keys[i + step])]
        near = np.bitwise_count(codes[i] ^ codes[i + step]) <= limit
        forest.add(i[near], i[near] + step)
    for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        for a, b in GrayTree(codes[start:start + size]).pairs(limit):
            forest.add(a + start, b + start)
    a = np.concatenate(forest.a) if forest.a else np.array([], int)
    b = np.concatenate(forest.b) if forest.b else np.array([], int)
    return codes[a], codes[b]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, codes = [], []
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        codes.append(batch.column(1).to_numpy().view(np.uint64))
    if keys:
        a, b = forest_links(np.concatenate(keys), np.concatenate(codes))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])


def links(codes: DataFrame, n: int) -> DataFrame:
    """(a, b): links between ``n`` distinct fingerprints (column ``code``); they join exactly the
    fingerprints that all pairs with at most two differing bits would join."""
    spark = codes.sparkSession
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(MASKS)))
    return (
        codes.select(F.explode(keys).alias("key"), "code")
        .repartition(n_partitions(spark, n * len(MASKS), 400_000), "key")
        .mapInArrow(_task, "a long, b long")
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(docs: DataFrame, carry: Column, text: Column, doc_id: Column) -> tuple[DataFrame, DataFrame]:
    """The written rows (__doc, __id, code, __n: a number of their own), and (code, component_id)."""
    rows = stored(docs.select(carry.alias("__doc"), doc_id.alias("__id"), _fingerprints(text.cast("string")).alias("code"), F.monotonically_increasing_id().alias("__n")))
    codes = stored(rows.groupBy("code").agg(F.min("__id").alias("low")))
    found = components(stored(links(codes.select("code"), codes.count())))
    placed = codes.join(found, codes["code"] == found["node"], "left").select(
        "code", "low", F.coalesce("component", "code").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, placed.join(lowest, "root").select("code", "root", "component_id")


def groups(docs: DataFrame, carry: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: __doc (``carry``, or the whole row as a struct), code (its fingerprint
    as a signed long) and component_id (smallest id of all rows that links reach).

    Null and empty texts have fingerprint 0 and are linked like any other. A null id is ignored as
    long as its component has another one. Repeated rows stay, in one component. Other columns may
    have any name, as they travel inside ``__doc``. An empty table gives an empty table.
    """
    rows, by_code = _grouped(docs, F.struct("*") if carry is None else carry, F.col(text), F.col(doc_id))
    return rows.join(by_code, "code").select("__doc", "code", "component_id")


def fingerprint_hex(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays, nulls
    last; of several rows with that id the first by content, then by place. The choice is made on
    ids alone; texts are shuffled once, to meet the rows chosen."""
    rows, by_code = _grouped(docs, F.struct("*"), F.col("text"), F.col("doc_id"))
    rank = F.struct(F.col("__id").isNull(), F.col("__id"), "__h", "__n")
    light = rows.select("__id", "code", "__n", F.xxhash64("__doc").alias("__h")).join(by_code, "code")
    chosen = light.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.__n").alias("__n"))
    return rows.join(chosen, "__n", "left_semi").select("__doc.*")
