"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes holds documents that came (+1), went (-1), or were counted anew (-1 with the old
count, +1 with the new). Changes are added up by key inside each task and then over tasks, so a
source with a third of all documents costs each task one row; only those sums are kept. A batch is a
folder of sums with Spark's own success mark: it is committed with one rename, counts once however
often it is sent, and a batch that was lost half-way does not exist. Totals are the sums over all
committed batches; compaction folds batches into one without losing which were in it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm.common import WORD, n_words, shared_folder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"

#: Counting rules by tokenizer version. The second one also cuts words at ASCII punctuation.
TOKENIZERS = {"words-1": WORD, "words-2": r"[A-Za-z0-9\x80-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}


def tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a whole text; 0 for null."""
    if tokenizer == "words-1":
        return n_words(text)
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def change(docs: DataFrame, sign: int, tokenizer: str, count: Column | None = None) -> DataFrame:
    """Rows of a batch: ``docs`` (source, lang, text) with ``sign``; null keys are keys of their own."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("documents"), (sign * (tokens(text, tokenizer) if count is None else F.coalesce(count, F.lit(0)))).cast("long").alias("tokens"))


class Rollup:
    """Totals in ``folder``, a place that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_folder(spark)).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changes, if one of that name is in already.

        Repeated rows inside a batch count as often as they stand there; an empty batch is committed
        and adds nothing; columns other than those of a change are not looked at.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"batch name {batch!r}")
        if batch in self.batches():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        self._write(batch, [batch], sums)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by key; keys whose last document went are left out."""
        paths = [f"{self.folder}/{name}/sums" for name in self._folders()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def batches(self) -> set[str]:
        """Names of all committed batches, those inside compacted ones included."""
        return self._batches_of(self._folders())

    def _batches_of(self, names: list[str]) -> set[str]:
        if not names:
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(*(f"{self.folder}/{n}/batches" for n in names)).collect()}

    def compact(self, name: str) -> None:
        """Fold all committed batches into one, ``name``; reading stays right at every moment.

        The new folder names those it replaces; they are skipped from the moment it appears and
        deleted after it.
        """
        old = self._folders()
        if not old:
            return
        self._write(name, sorted(self.batches()), self.totals(), old)
        for folder in old:
            self._fs.delete(self._path(f"{self.folder}/{folder}"), True)

    def _write(self, name: str, batches: list[str], sums: DataFrame, replaced: list[str] = ()) -> None:
        """One folder, complete under a hidden name of this writer's own before a rename shows it.

        Where another writer was first, the rename moves the folder inside the one that is there: it
        goes again, and so does a batch that has been folded into another one meanwhile.
        """
        own = f"_{name}-{uuid.uuid4().hex}"
        hidden, shown = f"{self.folder}/{own}", f"{self.folder}/{name}"
        sums.write.mode("overwrite").parquet(f"{hidden}/sums")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{hidden}/batches")
        self.spark.createDataFrame([(r,) for r in replaced], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{hidden}/replaced")
        moved, inside = self._fs.rename(self._path(hidden), self._path(shown)), self._path(f"{shown}/{own}")
        late = not moved or self._fs.exists(inside)
        if late:
            self._fs.delete(inside if moved else self._path(hidden), True)
        elif set(batches) & self._batches_of([n for n in self._folders() if n != name]):
            late = self._fs.delete(self._path(shown), True)
        if late:
            raise RuntimeError(f"batch {name} was committed by another job meanwhile")

    def _folders(self) -> list[str]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(root) if not s.getPath().getName().startswith("_"))
        if not names:
            return []
        gone = {r["folder"] for r in self.spark.read.schema("folder string").parquet(*(f"{self.folder}/{n}/replaced" for n in names)).collect()}
        return [n for n in names if n not in gone]
