"""Payloads of any size: SRC-4 for boards that no single value can hold.

A file is read as ordered pieces, each up to the next closing brace, by as many tasks as it has
splits. Running sums over the pieces tell where each one starts: the number of quotes before it
whether inside a text, the brackets outside texts how deep. From there a piece is cut at commas and
brackets of the level at which records stand. Further running sums number the lists and their
elements, and only the parts of one element are brought together. Each element is parsed on its
own, and what is left of the payload without elements shows whether its shape is right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.operators.running import running
from rolesieve.session import checkpointed
from rolesieve.sources.variant import parse_whole

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{},]', re.DOTALL)
_REST_OF_TEXT = re.compile(r'(?:[^"\\]|\\.)*+"?', re.DOTALL)

#: Elements of a list that joins bring together, as a power of two.
_BLOCK_BITS = 8
_PART = "token string, board_ord long, place long, sub long, inner boolean, opens long, starts long, kind string, text string"


def load_pieces(spark: SparkSession, folder: str, above: int = 0) -> DataFrame:
    """``token, place, text`` of the landed files of more than ``above`` bytes, one file per board.

    ``place`` grows along a file: the start of a split plus the number of the piece in it, which
    stays below the next split's start because a piece takes a byte at least.
    """
    files = spark.read.option("lineSep", "}").text(str(PurePosixPath(folder) / "*.json"))
    rows = checkpointed(files.where(F.col("_metadata.file_size") > above).select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("token"), "value",
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("id")))
    splits = rows.groupBy("token", "start").agg(F.min("id").alias("first"))
    placed = rows.join(splits, ["token", "start"]).withColumn("place", F.col("start") + F.col("id") - F.col("first"))
    # A last piece that the file ends without a brace has none: bytes and braces add up to the size.
    ends = placed.groupBy("token").agg(F.max("place").alias("last"), (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("closed"))
    brace = F.when((F.col("place") == F.col("last")) & ~F.col("closed"), "").otherwise("}")
    return placed.join(ends, "token").select("token", "place", F.concat("value", brace).alias("text"))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _brackets(text: Column, inside: Column) -> Column:
    """Opened less closed brackets outside texts; ``text`` has no escapes left."""
    outside = F.when(inside, F.regexp_replace(text, '^[^"]*+("|$)', "")).otherwise(text)
    outside = F.regexp_replace(outside, '"[^"]*+("|$)', "")
    return (_count(outside, "[{") - _count(outside, "]}")).cast("long")


def scan(text: str, inside: bool, depth: int, level: int) -> Iterator[tuple[bool, int, int, str | None, str]]:
    """Parts of a piece: (inner, opens, starts, kind, text). Inner parts belong to elements of a
    list or object at ``level``; the one that opens it says which kind it is."""
    start = _REST_OF_TEXT.match(text).end() if inside else 0
    at, inner, flags = 0, depth >= level, (0, 0, None)
    for m in _TOKEN.finditer(text, start):
        c = m[0][0]
        if c in "[{":
            depth += 1
            if depth == level:
                yield inner, *flags, text[at:m.end()]
                at, inner, flags = m.end(), True, (1, 0, c)
        elif c in "]}":
            if depth == level:
                yield inner, *flags, text[at:m.start()]
                at, inner, flags = m.start(), False, (0, 0, None)
            depth -= 1
        elif c == "," and depth == level:
            yield inner, *flags, text[at:m.start()]
            at, flags = m.end(), (0, 1, None)
    if at < len(text) or flags[0] or flags[1]:
        yield inner, *flags, text[at:]


def _scanner(level: int):
    names = [f.split()[0] for f in _PART.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for token, board, place, text, inside, depth in zip(*(c.to_pylist() for c in batch.columns)):
                out += ((token, board, place, sub, *part) for sub, part in enumerate(scan(text, inside, depth, level)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return task


@dataclass(frozen=True)
class Split:
    """Records as variants, and one row per board with its error (null when it is fine)."""

    records: DataFrame
    boards: DataFrame


def split(pieces: DataFrame, key: str | None, wanted: str, names: DataFrame | None = None) -> Split:
    """The elements of a list: the payload itself, or with ``key`` the list under that key.

    ``pieces`` has ``token, board_ord, place, text``; they may end anywhere but within an
    escape. A payload that is not JSON, or has no such list, gives no records but an error;
    of several lists under the key the last counts, as in a payload that is parsed whole.
    Further columns of ``names``, a row per board, come with the records.
    """
    board, level = ["token", "board_ord"], 2 if key else 1
    plain = F.replace(F.replace("text", F.lit("\\\\")), F.lit('\\"'))
    # the sort begins with the board, so that a large one is spread over many tasks
    quoted = running(pieces.select(*board, "place", "text"), board, "board_ord", ["token", "place"], {"quotes": ("sum", _count(plain, '"').cast("long"))}, inclusive=False)
    inside = F.coalesce("quotes", F.lit(0)) % 2 == 1
    quoted = quoted.withColumn("inside", inside).withColumn("change", _brackets(plain, F.col("inside")))
    deep = running(quoted.drop("quotes"), board, "board_ord", ["token", "place"], {"depth": ("sum", F.col("change"))}, inclusive=False)
    deep = checkpointed(deep.withColumn("depth", F.coalesce("depth", F.lit(0))))
    open_ends = deep.groupBy(*board).agg((F.sum("change") != 0).alias("open"))
    parts = deep.select(*board, "place", "text", "inside", "depth").mapInArrow(_scanner(level), _PART)
    numbered = checkpointed(running(parts, board, "board_ord", ["token", "place", "sub"], {
        "holder": ("sum", F.col("opens")), "element": ("sum", F.col("opens") + F.col("starts"))}))

    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sub", c.alias("text")))), lambda x: x["text"]), "")
    # what is left of a payload names its lists by their numbers, so that its parse finds the right one
    number = F.when(F.col("kind") == "[", F.col("holder").cast("string")).otherwise(F.concat(F.lit('"n":'), "holder"))
    shape = numbered.where("not inner or opens = 1").groupBy(*board).agg(joined(F.when(F.col("inner"), number).otherwise(F.col("text"))).alias("envelope"))
    # a board may hold any number of elements, so joins go by its blocks of elements, never by the board alone
    block = F.shiftright("element", _BLOCK_BITS).alias("block")
    kinds = numbered.where("opens = 1").select(*board, "holder", "kind")
    lists = numbered.where("inner").groupBy(*board, "holder").agg(F.min("element").alias("first"), F.max("element").alias("last"))
    blocks = checkpointed(lists.join(kinds, [*board, "holder"]).select(
        "*", F.explode(F.sequence(F.shiftright("first", _BLOCK_BITS), F.shiftright("last", _BLOCK_BITS))).alias("block")))
    elements = numbered.where("inner").groupBy(*board, "holder", "element").agg(joined(F.col("text")).alias("text")).select("*", block)
    blank = F.col("text").rlike(r"\A[ \t\r\n]*\z")
    elements = elements.join(blocks, [*board, "holder", "block"]).where(~(blank & (F.col("first") == F.col("last"))))
    value = F.when(F.col("kind") == "[", parse_whole("text")).when(~blank, parse_whole(F.concat(F.lit("{"), "text", F.lit("}"))))
    elements = checkpointed(elements.withColumn("record", value))

    broken = elements.groupBy(*board).agg(F.max(F.col("record").isNull()).alias("broken"))
    checked = open_ends.join(shape, board, "left").join(broken, board, "left").withColumn("_whole", parse_whole("envelope"))
    target = F.try_element_at(F.try_variant_get("_whole", "$." + key if key else "$", "array<long>"), F.lit(1))
    error = F.when(F.col("_whole").isNull() | F.col("open") | F.coalesce("broken", F.lit(False)), "invalid JSON").when(F.col("target").isNull(), wanted)
    boards = checkpointed(checked.withColumn("target", target).select(*board, "target", error.alias("payload_error")))
    good = boards.where("payload_error is null").select(*board, F.col("target").alias("holder"))
    good = good.join(names, board) if names is not None else good
    wanted_blocks = blocks.select(*board, "holder", "block").join(good, [*board, "holder"])
    records = elements.join(wanted_blocks, [*board, "holder", "block"]).select(
        *board, *(names.drop(*board).columns if names is not None else ()), (F.col("element") - F.col("first")).cast("int").alias("pos"), "record")
    return Split(records, boards.drop("target"))

