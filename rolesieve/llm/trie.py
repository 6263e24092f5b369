"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct beginning of conversations. Its key is a 128-bit digest of its depth and two
sums of 64-bit hashes of (place, turn), so keys come out of running sums, which no long
conversation overloads, and no text is shuffled. Nodes are counted with a map-side combine.

Totals of subtrees go up by time-forward processing. Nodes with more than ``CONVS`` members are
upper nodes, of which there is at most one for so many rows. Below them a path is cut every
``LEVELS`` levels; the nodes between two cuts form a shard. Each shard is sorted by reverse level
order (Spark's external sort) and read once; a node takes the messages addressed to it from a
priority queue, which spills, and sends its total to its parent. What a shard's root sends leaves
the shard: sums by receiver, then the same method once more over upper nodes and those roots, in
one task while they are few, else in shards of their own. Shards that hang above others are read
a second time, with what came from below.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import n_partitions, stored
from rolesieve.operators.running import running

#: A node with more members is an upper node; levels of a shard; nodes of the last pass in one task.
CONVS, LEVELS, LAST = 100, 1000, 100_000
#: Messages that a queue holds in memory, and files that it keeps before it merges them.
IN_MEMORY, FILES = 200_000, 32
#: Rows of a task, and ids of a piece of a node's id list (as a power of two).
ROWS, PIECE_BITS = 400_000, 12


class Messages:
    """Priority queue of (place, numbers): the numbers for the smallest place come out summed.

    At most ``most`` messages stay in memory; beyond that they go to a file as a sorted run.
    """

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.heap, self.runs = most, [], []  # runs: heap of (message, number, rest of the run)
        self.made = 0

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)

    def push(self, place, numbers: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, (place, numbers))
        if len(self.heap) > self.most:
            self._add(self._written(iter(sorted(self.heap))))
            self.heap = []
            if len(self.runs) > FILES:
                fronts, self.runs = self.runs, []
                self._add(self._written(heapq.merge(*(self._whole(first, rest) for first, _, rest in fronts))))

    def pop(self, place) -> Iterator[tuple[int, ...]]:
        """All numbers sent to ``place``, which must not be larger than any place still to come."""
        while self.heap and self.heap[0][0] == place:
            yield heapq.heappop(self.heap)[1]
        while self.runs and self.runs[0][0][0] == place:
            (_, numbers), number, rest = self.runs[0]
            following = next(rest, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, rest))
            yield numbers

    def _add(self, run: Iterator) -> None:
        first = next(run, None)
        if first is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, run))

    @staticmethod
    def _whole(first, rest):
        yield first
        yield from rest

    @staticmethod
    def _written(messages: Iterator) -> Iterator:
        file = tempfile.TemporaryFile()  # has no name, and goes with the task whatever ends it
        step = []
        for m in messages:
            step.append(m)
            if len(step) == 1000:
                pickle.dump(step, file)
                step = []
        pickle.dump(step, file)
        file.seek(0)

        def read():
            with file:
                while True:
                    try:
                        yield from pickle.load(file)
                    except EOFError:
                        return

        return read()


SENT = "key binary, shard binary, leaves long, saved long"


def _forward(most: int):
    """Totals of nodes (key, parent, shard, depth, leaves, saved) in reverse level order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Messages(most)
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            leaves_out, saved_out = [], []
            for key, parent, shard, depth, leaves, saved in zip(*cols):
                for a, b in queue.pop((-depth, key)):
                    leaves += a
                    saved += b
                leaves_out.append(leaves)
                saved_out.append(saved)
                if key != shard:
                    queue.push((1 - depth, parent), (leaves, saved))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(leaves_out, pa.int64()), pa.array(saved_out, pa.int64())],
                names=["key", "shard", "leaves", "saved"])
        if len(queue):
            raise ValueError("a node's parent is not in its shard")

    return task


def _passed(nodes: DataFrame, parts: int, most: int) -> DataFrame:
    dealt = nodes.select("key", "parent", "shard", "depth", "leaves", "saved").repartition(parts, "shard")
    return dealt.sortWithinPartitions(F.col("depth").desc(), "key").mapInArrow(_forward(most), SENT)


def totals(paths: DataFrame, nodes: DataFrame, members: int = CONVS, levels: int = LEVELS, last: int = LAST,
           most: int = IN_MEMORY, above: int | None = None) -> DataFrame:
    """(key, leaves, saved) of every node, summed over its subtree.

    ``paths`` (conv, depth, key) has the nodes of each conversation from depth 1 on; ``nodes`` (key,
    parent, conv: a member, depth, n: members, leaves, saved) has their own numbers, and the root
    with depth 0. ``above``, the bound of members from which a node is an upper one, grows by
    ``members`` with each round over what is left; ``levels`` is 2 or more.
    """
    spark, above = nodes.sparkSession, above or members
    top = (F.col("n") > above) | (F.col("depth") == 0)
    heavy = stored(nodes.where(top))
    reach = paths.join(heavy.select("key"), "key", "left_semi").groupBy("conv").agg(F.max("depth").alias("__upper"))
    rel = F.col("depth") - F.coalesce("__upper", F.lit(0)) - 1
    cuts = stored(paths.join(reach, "conv", "left").withColumn("__rel", rel).where((F.col("__rel") >= 0) & (F.col("__rel") % levels == 0))
                  .select("conv", F.expr(f"__rel div {levels}").alias("__band"), F.col("key").alias("shard"), "depth", F.coalesce("__upper", F.lit(0)).alias("__upper")))
    placed = stored(nodes.where(~top).join(reach, "conv", "left").withColumn("__rel", rel).withColumn("__band", F.expr(f"__rel div {levels}"))
                    .join(cuts.select("conv", "__band", "shard"), ["conv", "__band"]).drop("__rel", "__upper"))
    count, bands = placed.agg(F.count("*"), F.coalesce(F.max("__band"), F.lit(0))).first()
    parts = n_partitions(spark, count, ROWS)
    local = stored(_passed(placed, parts, most))

    roots = placed.where("key = shard").drop("leaves", "saved").join(local.where("key = shard").select("key", "leaves", "saved"), "key")
    if not bands:  # no shard hangs below another: all roots report to upper nodes
        small = _added(heavy, roots)
        return _last(paths, small, heavy.select("key"), members, levels, last, most, above).unionByName(local.select("key", "leaves", "saved"))

    roots = stored(roots)
    higher = cuts.select("conv", (F.col("__band") + 1).alias("__band"), F.col("shard").alias("__higher"))
    deep = stored(roots.where("__band > 0").join(higher, ["conv", "__band"]))
    opened = stored(deep.select("key").unionByName(deep.select(F.col("__higher").alias("key"))).distinct())
    left = roots.join(opened, "key", "left_semi").join(deep.select("key", "__higher"), "key", "left").join(
        cuts.select("conv", "__band", "__upper"), ["conv", "__band"])
    small = _added(heavy, roots.join(opened, "key", "left_anti")).unionByName(left.select(
        "key", F.coalesce("__higher", "parent").alias("parent"), "conv", (F.col("__upper") + 1 + F.col("__band")).alias("depth"), "n", "leaves", "saved"))
    small = stored(small)
    short = paths.join(heavy.select("key"), "key", "left_semi").select("conv", "depth", "key").unionByName(
        cuts.withColumnRenamed("shard", "key").join(opened, "key", "left_semi").select("conv", (F.col("__upper") + 1 + F.col("__band")).alias("depth"), "key"))
    found = stored(_last(short, small, small.select("key"), members, levels, last, most, above))

    below = deep.select("key", "parent").join(found, "key").groupBy("parent").agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
    again = placed.join(opened.withColumnRenamed("key", "shard"), "shard", "left_semi").join(below.withColumnRenamed("parent", "key"), "key", "left")
    again = again.withColumns({"leaves": F.col("leaves") + F.coalesce("__l", F.lit(0)), "saved": F.col("saved") + F.coalesce("__s", F.lit(0))})
    closed = local.join(opened.withColumnRenamed("key", "shard"), "shard", "left_anti")
    return found.join(heavy.select("key"), "key", "left_semi").unionByName(closed.select("key", "leaves", "saved")).unionByName(
        _passed(again, parts, most).select("key", "leaves", "saved"))


def _added(heavy: DataFrame, roots: DataFrame) -> DataFrame:
    """Upper nodes with what the shards below them report."""
    sent = roots.groupBy(F.col("parent").alias("key")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
    return heavy.join(sent, "key", "left").select("key", "parent", "conv", "depth", "n", (F.col("leaves") + F.coalesce("__l", F.lit(0))).alias("leaves"),
                                                  (F.col("saved") + F.coalesce("__s", F.lit(0))).alias("saved"))


def _last(paths, small, keys, members, levels, last, most, above) -> DataFrame:
    """Totals of what is left: in one pass while it is small, else in shards again."""
    small = stored(small)
    if small.count() <= last:
        return _passed(small.withColumn("shard", F.lit(ROOT)), 1, most).select("key", "leaves", "saved")
    return totals(paths.join(keys, "key", "left_semi").select("conv", "depth", "key"), small, members, levels, last, most, above * max(2, members))


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, a, b)))


ROOT = hashlib.md5(b"0:0:0").digest()


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, chars) for ``turns`` (conv, place 1.., token, chars)."""
    number = lambda i: F.xxhash64(F.lit(i), "place", "token").cast("decimal(20,0)")
    light = turns.select("conv", F.col("place").cast("long").alias("place"), "chars", number(1).alias("x"), number(2).alias("y"))
    summed = running(light, ["conv"], "conv", ["place"], {"a": ("sum", F.col("x")), "b": ("sum", F.col("y"))})
    return summed.select("conv", F.col("place").alias("depth"), _key(F.col("place"), F.col("a"), F.col("b")).alias("key"),
                         _key(F.col("place") - 1, F.col("a") - F.col("x"), F.col("b") - F.col("y")).alias("parent"), F.col("chars").cast("long").alias("chars"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; the state of one key is held."""
    now, state, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield _pairs(out)
            out = []
    if state:
        out.append((now, state.hexdigest()))
    yield _pairs(out)


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) for ``last`` (key, conv: whole number), one row per conversation.

    Ids meet in pieces of neighbouring numbers, and only pieces are sorted by node; a digest is made
    from beginning to end by its nature, so a node's pieces stream through one task, one at a time.
    """
    pieces = last.groupBy("key", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame | None = None, **limits) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv: whole number, place 1.., role, text).

    ``convs`` (conv) names all conversations, so that those without a turn end in the root; by default
    those of ``turns``. Columns: key and parent (digests), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (over the subtree), ends_sha256.
    Places must be 1, 2, ... in each conversation; :func:`placed` makes them. A null role or text is
    an empty one. Rows and ids with a null ``conv`` are no conversation and are left out; repeated
    ids of ``convs`` count once. No conversation gives no node, not even a root.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = turns.where("conv is not null").select("conv", "place", token(F.col("role"), F.col("text")).alias("token"), F.length(text).alias("chars"))
    return of_tokens(light, convs, **limits)


def token(role: Column, text: Column) -> Column:
    """Digest of a turn; null role and text are empty."""
    role, text = (F.coalesce(x.cast("string"), F.lit("")) for x in (role, text))
    return F.md5(F.concat(F.length(role), F.lit(":"), role, text))


def of_tokens(turns: DataFrame, convs: DataFrame | None = None, **limits) -> DataFrame:
    """The trie of ``turns`` whose texts are digests already (conv, place, token, chars)."""
    paths = stored(paths_of(turns))
    ids = (turns if convs is None else convs).where("conv is not null").select("conv").distinct()
    last = paths.groupBy("conv").agg(F.max_by("key", "depth").alias("key"))
    last = stored(ids.join(last, "conv", "left").select("conv", F.coalesce("key", F.lit(ROOT)).alias("key")))
    found = paths.groupBy("key").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.count("*").alias("n"))
    root = last.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0").select(
        F.lit(ROOT).alias("key"), "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "n")
    nodes = stored(found.unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    nodes = stored(nodes.join(children, "key", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))
    own = nodes.select("key", "parent", "conv", "depth", "n", (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    summed = totals(paths.select("conv", "depth", "key"), own, **limits)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(summed, "key").join(ends(last), "key", "left").join(parents, "parent", "left").select(
        "key", "parent", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of each node's last turn, null for the root."""
    rows = turns.select(F.col("conv").alias("conv_id"), F.col("place").cast("long").alias("depth"), "role", "text")
    return nodes.join(rows, ["conv_id", "depth"], "left")


def placed(turns: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """``turns`` with ``place`` 1, 2, ... by ``order`` (nulls first) in each conversation."""
    return running(turns, [conv], conv, order, {"place": ("sum", F.lit(1).cast("long"))})
