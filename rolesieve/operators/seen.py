"""First copies over several collections: WIN-1 with a memory.

Pages that earlier collections kept stand in a folder of key tables. A collection is reduced to
its own first copies, and those that an earlier collection kept are left out by an anti join on
keys. Nothing of the earlier rows is read but their keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.operators.dedup import deduplicate, keyed
from rolesieve.session import checkpointed

KEY_SCHEMA = "_hash long, _url string"
CLAIM_SCHEMA = "place int, collection string, keys string"


@dataclass(frozen=True)
class SeenPages:
    """The pages that collections have kept so far, in a ``folder`` that all executors share.

    Each collection's keys are a table of their own, and count from the moment a small claim file
    with the next number names them. The file is created only if it is not there yet, so of two
    collections that run at once one comes in and the other is told to run again; a run that is lost
    before its claim leaves keys that nothing names.
    """

    spark: SparkSession
    folder: str

    def claims(self) -> list[tuple[str, str]]:
        """Collections so far with their keys, in order; one small line each."""
        path = self._path("claims")
        if not self._store(path).exists(path):
            return []
        lines = self.spark.read.schema(CLAIM_SCHEMA).json(f"{self.folder}/claims").collect()
        claims = sorted((r.place, r.collection, r.keys) for r in lines)
        if [place for place, *_ in claims] != list(range(len(claims))):
            raise RuntimeError("a claim is being written; run again")
        return [(collection, keys) for _, collection, keys in claims]

    def keep_new(self, jobs: DataFrame, collection: str, seq: str = "seq") -> DataFrame:
        """WIN-1: first rows of the pages that no earlier collection kept, and remembers them.

        Over collections in their order this gives the rows that one table of all of them would.
        Rows without a URL always stay and are not remembered. A name that has come in already gives
        the same rows again, by what stood before it, and changes nothing. The columns are those of
        ``jobs``; the result is written to the checkpoint folder, so it can be read more than once.
        """
        claims = self.claims()
        names = [name for name, _ in claims]
        place = names.index(collection) if collection in names else len(claims)
        first, _ = keyed(deduplicate(jobs, seq), seq)
        new = first
        if place:
            before = self.spark.read.schema(KEY_SCHEMA).parquet(*(f"{self.folder}/{keys}" for _, keys in claims[:place]))
            new = first.join(before.select(F.col("_hash").alias("_seen_hash"), F.col("_url").alias("_seen_url")),
                             (F.col("_hash") == F.col("_seen_hash")) & (F.col("_url") == F.col("_seen_url")), "left_anti")
        new = checkpointed(new)
        if place == len(claims):
            keys = f"keys-{uuid.uuid4().hex}"
            new.filter("_blank is null").select("_hash", "_url").write.parquet(f"{self.folder}/{keys}")
            self._claim(place, collection, keys)
        return new.select(*jobs.columns)

    def _claim(self, place: int, collection: str, keys: str) -> None:
        path = self._path(f"claims/{place:08d}.json")
        line = json.dumps({"place": place, "collection": collection, "keys": keys}) + "\n"
        try:
            out = self._store(path).create(path, False)
        except Exception as exc:
            raise RuntimeError(f"another collection came in before {collection!r}; run it again") from exc
        out.write(bytearray(line.encode()))
        out.close()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())
