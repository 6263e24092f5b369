"""Packing by vector bin packing under limits on tokens, segments and loss-bearing tokens.

Examples are placed by the dot-product heuristic: of all examples that still fit, the one whose
demand points most along what a sequence has left goes next, each dimension weighted by its mean
demand. Examples are dealt over groups of bounded size by row, so one source or a mass of copies
never meets in a task, and every group is packed whole inside a task.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolesieve.llm.common import n_partitions, stored

LENGTH = 2048
#: Segments of a sequence at most, and loss-bearing tokens at most.
SEGMENTS, LOSS = 256, 2048
#: Examples of a group, about.
GROUP = 8192
END = 1


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in the file ``path`` of ranks; its ids and those of the JSON file
    of the same vocabulary are equal, as a test checks."""
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@lru_cache(maxsize=2)
def json_tokenizer(path: str) -> Tokenizer:
    """The same vocabulary from the JSON file beside the file ``path`` of ranks."""
    return Tokenizer.from_file(str(Path(path).with_suffix(".json")))


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text (null: empty) and the closing id. The pattern of ``tiktoken`` refuses runs
    of about a million blanks; such a text is encoded whole by ``tokenizers``."""
    try:
        ids = tokenizer(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        ids = json_tokenizer(path).encode(text or "", add_special_tokens=False).ids
    return np.append(ids, END).astype("<u4")


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens.

    A document is cut after every ``length`` ids; each id lies in one piece. An empty or null text is
    the closing id alone; repeated rows and null ids give pieces like any other row.
    """
    path = path or public_path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, size, crc, whole = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py(), path)
                for s in range(0, len(ids), length):
                    part = ids[s:s + length]
                    at.append(i)
                    start.append(s)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    whole.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, whole))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def prompt_pieces(rows: DataFrame, prompt: str, answer: str, path: str | None = None, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LOSS)) -> DataFrame:
    """Token pieces of instruction examples: all columns of ``rows``, then start, length, ids_crc32,
    doc_tokens, segments and loss_tokens.

    An example is the ids of its prompt, those of its answer and the closing id; answer and closing
    id bear loss. It is cut where a piece would exceed the tokens or the loss-bearing tokens of a
    sequence, and nowhere else; each id lies in one piece, and each piece is a segment. A null prompt
    or answer is empty; repeated rows and nulls in other columns are rows like any other. Columns of
    ``rows`` that are named like one of the six are replaced.
    """
    path = path or public_path("byte_bpe_50k.tiktoken")
    length, _, loss = limits
    if length < 1 or loss < 1:
        raise ValueError("a sequence must have room for one loss-bearing token")

    @F.pandas_udf("array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long,segments:long,loss_tokens:long>>")
    def cut(prompts: pd.Series, answers: pd.Series) -> pd.Series:
        out = []
        for asked, told in zip(prompts, answers):
            head = token_ids(asked, path)[:-1]
            ids, parts, s = np.append(head, token_ids(told, path)).astype("<u4"), [], 0
            while s < len(ids):
                e = min(s + length, len(ids), max(s, len(head)) + loss)
                parts.append({"start": s, "length": e - s, "ids_crc32": zlib.crc32(ids[s:e].tobytes()), "doc_tokens": len(ids),
                              "segments": 1, "loss_tokens": max(0, e - max(s, len(head)))})
                s = e
            out.append(parts)
        return pd.Series(out)

    names = ("start", "length", "ids_crc32", "doc_tokens", "segments", "loss_tokens")
    texts = (F.col(c).cast("string") for c in (prompt, answer))
    exploded = rows.select(F.struct("*").alias("__row"), F.explode(cut(*texts)).alias("__piece"))
    return exploded.select(*(F.col("__row")[c].alias(c) for c in rows.columns if c not in names), *(F.col("__piece")[n].alias(n) for n in names))


def pack_prompts(rows: DataFrame, prompt: str, answer: str, path: str | None = None, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LOSS)) -> DataFrame:
    """``prompt_pieces`` with sequence_id and offset: no sequence has more tokens, segments or
    loss-bearing tokens than ``limits``. An empty table stays empty."""
    return pack(prompt_pieces(rows, prompt, answer, path, limits), "length", "segments", "loss_tokens", limits)


def place(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order in it for each row of ``demands``; no bin exceeds ``limits`` in any column.

    Rows with equal demands are one kind, so a step costs as many comparisons as there are kinds.
    A row that alone exceeds a limit is an error.
    """
    if len(demands) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (demands > limits).any():
        raise ValueError("an example exceeds the limits of a sequence")
    kinds, kind = np.unique(demands, axis=0, return_inverse=True)
    rows = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    count = np.bincount(kind)
    pull = kinds / limits * (demands.mean(axis=0) / limits)  # scaled, and weighted by mean demand
    bins, order = np.zeros(len(demands), np.int64), np.zeros(len(demands), np.int64)
    left, opened, inside, live = limits.astype(float), 0, 0, np.arange(len(kinds))
    while len(live):
        fits = live[(kinds[live] <= left).all(axis=1)]
        if not len(fits):
            left, opened, inside = limits.astype(float), opened + 1, 0
            continue
        best = fits[np.argmax(pull[fits] @ (left / limits))]
        count[best] -= 1
        row = rows[best][count[best]]
        bins[row], order[row] = opened, inside
        left, inside = left - kinds[best], inside + 1
        if not count[best]:
            live = live[live != best]
    return bins, order


def pack(examples: DataFrame, tokens: str, segments: str, loss: str, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LOSS)) -> DataFrame:
    """``examples`` with sequence_id and offset (tokens before it in its sequence, without gaps).

    The three columns name an example's demands; null counts as 0. ``examples`` is written down
    first, so that its dealing is the same if a lost task runs again. Repeated rows are packed like
    any other; an empty table stays empty. Columns of ``examples`` named sequence_id or offset are
    replaced, others may have any name.
    """
    spark = examples.sparkSession
    rows = stored(examples)
    groups = max(1, -(-rows.count() // GROUP))
    bound = np.array(limits)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row", ignore_index=True)
        bins, order = place(pdf[["__t", "__s", "__l"]].to_numpy(np.int64), bound)
        by = np.lexsort((order, bins))
        before = np.cumsum(pdf["__t"].to_numpy()[by]) - pdf["__t"].to_numpy()[by]
        first = np.r_[True, bins[by][1:] != bins[by][:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = pdf["__group"].to_numpy() * (1 << 20) + bins  # a group has fewer sequences than examples
        pdf["offset"] = offset
        return pdf[["__row", "sequence_id", "offset"]]

    number = F.monotonically_increasing_id()
    numbered = rows.select(F.struct("*").alias("__in"), number.alias("__row"))
    dealt = numbered.select("__row", F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("__group"), *(
        F.coalesce(F.col("__in")[c].cast("long"), F.lit(0)).alias(n) for c, n in ((tokens, "__t"), (segments, "__s"), (loss, "__l"))))
    # a row of another group is never needed, so the number of groups in a task does not matter
    placed = dealt.repartition(n_partitions(spark, groups, 1), "__group").groupBy("__group").applyInPandas(packed, "__row long, sequence_id long, offset long")
    kept = (F.col("__in")[c].alias(c) for c in rows.columns if c not in ("sequence_id", "offset"))
    return numbered.join(placed, "__row").select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Full pieces are sequences of their own; the rest is packed. A piece is one segment, and all its
    tokens but the first bear loss, as nothing in the sequence predicts that one.
    """
    cut = stored(pieces(docs, path, length).withColumn("segments", F.lit(1)).withColumn("loss_tokens", F.col("length") - 1))
    full = cut.where(F.col("length") == length).select(
        "*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pack(cut.where(F.col("length") < length), "length", "segments", "loss_tokens", (length, SEGMENTS, min(LOSS, length)))
    return full.unionByName(rest.withColumn("sequence_id", 2 * F.col("sequence_id")))
