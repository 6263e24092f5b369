"""Repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus.

A passage of ``WINDOW`` words that occurs twice must be found wherever it starts. Each window has an
anchor, its least ``GRAM``-word sequence by hash (the leftmost of equals), so equal windows have
equal anchors at equal places. Neighbouring windows with one anchor form a segment; about seven
of a hundred words begin one. The segments of all documents are the reference, indexed in blocks by
anchor; a document meets those blocks that its own anchors name, which are all that can hold a
factor of a window or more.

A document is factored greedily: a segment whose whole words stand in the index a second time
extends the factor by all of its windows. A factor can only begin or end in a segment whose anchor
is known with other words around it; there, at the factor boundaries, the windows are looked
up one by one, among one copy of each different segment of that anchor. Factors of a window or
more are the duplicate spans. A window is judged by what the input holds, so order does not matter.

Shuffled are segments (48 bytes each), windows at boundaries, and compressed texts for the two passes
that read words again. Keys are 64-bit anchors with 64-bit digests of the words, texts go by 128 bits. Copies of
a segment are counted with a map-side combine, and joins on hot keys are plain equi-joins, which
adaptive execution splits; no group is gathered but the spans of one text. Copies of a text are read
and cleaned once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rolesieve.llm.common import stored

WINDOW, GRAM = 35, 8
#: Bytes of a text whose words are held at a time, and windows of one step.
TEXT_STEP, STEP = 1 << 20, 1 << 18
#: Segments or windows of an output batch.
BATCH = 1 << 17
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    n = STEP + 2 * WINDOW + 2
    up = np.full(n, base, _U)
    down = np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_FOR_ANCHORS, _FOR_WORDS = _powers(0x9E3779B97F4A7C15 | 1), _powers(0xC2B2AE3D27D4EB4F | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number at a time."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + TEXT_STEP)
        end = gap.start() if gap else len(text)
        yield text[start:end].split()
        start = end


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, words), _U, len(words)) for words in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, _U)


class Hashes:
    """Hashes of all word sequences of one part of a text."""

    def __init__(self, words: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        up, self.down = powers
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window, and the keys of all places."""
    at = np.arange(len(words) - GRAM + 1)
    grams = Hashes(words, _FOR_ANCHORS).of(at, at + GRAM)
    low, place, width = grams, at, 1
    while width < WINDOW - GRAM + 1:
        step = min(width, WINDOW - GRAM + 1 - width)
        right = low[step:] < low[:-step]  # of equals the left one
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    return place, grams


def segments(words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, last window, anchor's key, digest) of all segments, a bounded number at a time.

    A segment that a step cuts differs from uncut ones; its windows are then compared one by one.
    """
    with np.errstate(over="ignore"):
        for start in range(0, len(words) - WINDOW + 1, STEP):
            part = words[start:start + STEP + WINDOW - 1]
            place, grams = anchors(part)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            last = np.r_[first[1:], len(place)] - 1
            anchor = place[first]
            shape = ((last - first) << 8 | (anchor - first)).astype(_U)
            digest = _mixed(Hashes(part, _FOR_WORDS).of(first, last + WINDOW) ^ _mixed(shape + _U(1)))
            yield first + start, last + start, grams[anchor].view(np.int64), digest.view(np.int64)


def windows(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and digests of the windows first..last of several segments."""
    size = last - first + 1
    start = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    digest = np.zeros(len(start), _U)
    with np.errstate(over="ignore"):
        for low in range(0, len(words), STEP):
            here = np.flatnonzero((start >= low) & (start < low + STEP))
            if len(here):
                at = start[here] - low
                digest[here] = Hashes(words[low:low + STEP + WINDOW - 1], _FOR_WORDS).of(at, at + WINDOW)
    return start, digest.view(np.int64)


SEGMENT = "a long, b long, at long, key long, digest long"
#: ``at`` holds a segment's first window and, in the low bits, how many windows follow it.
_BITS = 8


def _batches(columns: list[list[np.ndarray]], names: list[str], flush: bool) -> Iterator[pa.RecordBatch]:
    if columns[0] and (flush or sum(map(len, columns[0])) > BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=names)
        for c in columns:
            c.clear()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, names = [[] for _ in range(5)], ["a", "b", "at", "key", "digest"]
    for batch in batches:
        ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, text in enumerate(batch.column(2)):
            for first, last, key, digest in segments(word_hashes(text.as_py().encode())):
                values = np.full(len(first), ids[0][i]), np.full(len(first), ids[1][i]), first << _BITS | last - first, key, digest
                for c, v in zip(out, values):
                    c.append(v)
            yield from _batches(out, names, False)
    yield from _batches(out, names, True)


WINDOWS = "a long, b long, start long, key long, digest long, open long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the segments (ats, keys, open: not known to be repeated as a whole) of each text."""
    out, names = [[] for _ in range(6)], ["a", "b", "start", "key", "digest", "open"]
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for a, b, text, ats, keys, opens in zip(*batch.columns):
            at, key, unknown = (np.array(x.as_py(), np.int64) for x in (ats, keys, opens))
            first, size = at >> _BITS, (at & (1 << _BITS) - 1) + 1
            start, digest = windows(word_hashes(unpack(text.as_py())), first, first + size - 1)
            for c, v in zip(out, (np.full(len(start), a.as_py()), np.full(len(start), b.as_py()), start, np.repeat(key, size), digest, np.repeat(unknown, size))):
                c.append(v)
            yield from _batches(out, names, False)
    yield from _batches(out, names, True)


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([pack(t.encode()) for t in texts], dtype=object)


def numbered_texts(docs: DataFrame, text: Column, *more: Column) -> DataFrame:
    """(a, b: 128 bits of a text, text, ``more``); a null text is an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"), *more)


def once(texts: DataFrame) -> DataFrame:
    """(a, b, text: packed) of each different text; copies go before the shuffle."""
    return texts.select("a", "b", _packed("text").alias("text")).groupBy("a", "b").agg(F.first("text").alias("text"))


def index(texts: DataFrame) -> DataFrame:
    """The segments of all texts (a, b, at, key, digest), written."""
    return stored(texts.select("a", "b", "text").mapInArrow(_segments, SEGMENT))


def repeated(texts: DataFrame, reference: DataFrame) -> DataFrame:
    """(a, b, at): runs of windows, each of which occurs in the ``reference`` a second time; copies of a
    text repeat its rows."""
    place = F.xxhash64("a", "b", "at")
    copies = reference.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    varied = reference.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select(F.col("key").alias("k"))
    marked = copies.join(varied, F.col("key") == F.col("k"), "left").where("n > 1 or k is not null").select(
        "key", "digest", (F.col("n") > 1).alias("whole"), F.when(F.col("k").isNotNull(), F.col("one")).alias("one"))
    met = reference.join(marked, ["key", "digest"]).select("a", "b", "at", "key", "whole", (place == F.col("one")).alias("edge"))
    met = stored(met.where("whole or edge"))
    # the place of a segment is the same in all copies of a text, which are read as one
    edges = met.where("edge").groupBy("a", "b").agg(F.collect_set(F.struct("at", "key", (~F.col("whole")).cast("long").alias("open"))).alias("s"))
    read = once(texts).join(edges, ["a", "b"]).select("a", "b", "text", "s.at", "s.key", "s.open").mapInArrow(_windows, WINDOWS)
    looked = stored(read)
    twice = looked.groupBy("key", "digest").agg(F.count("*").alias("n")).where("n > 1").select("key", "digest")
    found = looked.where("open = 1").select("a", "b", "start", "key", "digest").join(twice, ["key", "digest"], "left_semi").select("a", "b", F.shiftleft("start", _BITS).alias("at"))
    return met.where("whole").select("a", "b", "at").unionByName(found)


def covered(n_words: int, ats: list[int] | None) -> np.ndarray:
    """Which words the runs of windows cover."""
    change = np.zeros(n_words + 1, np.int32)
    at = np.array([] if ats is None else ats, np.int64)
    first = at >> _BITS
    np.add.at(change, first, 1)
    np.add.at(change, first + (at & (1 << _BITS) - 1) + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def spans(n_words: int, ats: list[int] | None) -> list[tuple[int, int]]:
    """First and end of the stretches of covered words."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered(n_words, ats), False].astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


class Factors:
    """Repeated passages of ``docs``: every word that some window of ``WINDOW`` words covers which occurs
    anywhere else, in the same document or another.

    Null texts have no words. Repeated rows are copies of each other, so all of their windows are
    repeated. Ids play no part, and other columns may have any name. Texts of fewer words than a
    window lose nothing; an empty table gives an empty one.
    """

    def __init__(self, docs: DataFrame, text: str = "text", carry: Column | None = None):
        self.texts = numbered_texts(docs, F.col(text), (F.struct("*") if carry is None else carry).alias("__doc"))
        runs = repeated(self.texts, index(self.texts))
        self.runs = runs.groupBy("a", "b").agg(F.collect_set("at").alias("ats"))

    def _joined(self, schema: str, task) -> DataFrame:
        rows = once(self.texts).join(self.runs, ["a", "b"], "left")
        names = [f.split()[0] for f in schema.split(", ")]
        out = rows.select("a", "b", _by_text(schema, task)(F.col("text"), F.col("ats")).alias("__r"))
        return self.texts.select("a", "b", "__doc").join(out, ["a", "b"]).select("__doc", *(F.col(f"__r.{n}").alias(n) for n in names))

    def counts(self) -> DataFrame:
        """__doc, n_words, n_removed and kept_sha256 (of the words left, joined by one space)."""
        return self._joined("n_words long, n_removed long, kept_sha256 string", _counted)

    def spans(self) -> DataFrame:
        """__doc and spans: (first word, end) of each stretch of repeated words."""
        return self._joined("spans array<struct<first:bigint,end:bigint>>", _spanned)

    def kept(self) -> DataFrame:
        """__doc and kept: the text without repeated words, what is left joined by one space."""
        return self._joined("kept string", _cleaned)


def _by_text(schema: str, task):
    @F.pandas_udf(schema)
    def udf(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]
        unpack = zstandard.ZstdDecompressor().decompress
        return pd.DataFrame([task(unpack(t), r) for t, r in zip(texts, runs)], columns=names)

    return udf


def _left(text: bytes, ats) -> Iterator[tuple[int, list[bytes]]]:
    """Of each piece of a text: its number of words, and the words that stay."""
    if ats is None:
        yield from ((len(words), words) for words in pieces(text))
        return
    parts = list(pieces(text)) if len(text) <= TEXT_STEP else None
    n = sum(map(len, parts if parts is not None else pieces(text)))
    gone, at = covered(n, ats), 0
    for words in parts if parts is not None else pieces(text):
        yield len(words), [w for w, x in zip(words, gone[at:at + len(words)].tolist()) if not x]
        at += len(words)


def _counted(text: bytes, ats) -> tuple[int, int, str]:
    digest, n, kept = hashlib.sha256(), 0, 0
    for size, words in _left(text, ats):
        if words:
            digest.update((b" " if kept else b"") + b" ".join(words))
        n, kept = n + size, kept + len(words)
    return n, n - kept, digest.hexdigest()


def _spanned(text: bytes, ats) -> tuple[list[dict]]:
    found = spans(sum(map(len, pieces(text))), ats) if ats is not None else []
    return ([{"first": a, "end": b} for a, b in found],)


def _cleaned(text: bytes, ats) -> tuple[str]:
    return (" ".join(x for x in (b" ".join(words).decode() for _, words in _left(text, ats)) if x),)
