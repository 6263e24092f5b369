"""The prefix trie against brute force: long and hot paths, shards at every cut, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rolesieve.llm import queries, trie

TURNS = "conv long, place long, role string, text string"


def plain(paths):
    """Nodes from {conv: [(role, text), ...]}."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, inside in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = lambda x: sum(len(y) == len(x) + 1 and y[:-1] == x for y in members)
        ends = ",".join(map(str, sorted(c for c in inside if len(paths[c]) == len(node))))
        out.add((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children(node), sum(not children(x) for x in below),
                 sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(nodes):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect()]


def branching(seed, convs, longest):
    rng = random.Random(seed)
    paths = {c: [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc é"])) for _ in range(rng.randint(0, longest))] for c in rng.sample(range(-5, 9000), convs)}
    some = list(paths)
    for c in some[:convs // 3]:
        paths[c] = list(paths[some[-1]])[:rng.choice([2, 99])]  # a group of copies and of beginnings
    return paths


@pytest.mark.parametrize("limits", [{}, {"members": 3, "levels": 2, "last": 2, "most": 2}, {"members": 5, "levels": 3, "last": 50}])
def test_trie_against_brute_force(spark, limits):
    paths = branching(1, 40, 9)
    paths[50_000] = [("user", str(i // 2)) for i in range(30)]  # a long path
    paths[50_001] = paths[50_000][:25] + [("user", "end")]
    rows = [(c, i, *t) for c, turns in paths.items() for i, t in enumerate(turns, 1)]
    nodes = trie.trie(spark.createDataFrame(rows, TURNS), spark.createDataFrame([(c,) for c in paths] * 2, "conv long"), **limits)
    got = found(nodes)
    assert len(got) == len(set(got)) and set(got) == plain(paths)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, 1, None, None), (1, 2, "user", ""), (2, 1, "", ""), (3, 1, "u", "ser"), (4, 1, "us", "er")]
    extra = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "depth": F.lit("x"), "a": F.lit(2.0), "_bucket": F.lit(1)})
    nodes = trie.trie(extra)
    assert set(found(nodes)) == plain({1: [("", ""), ("user", "")], 2: [("", "")], 3: [("u", "ser")], 4: [("us", "er")]})
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_turns(nodes, extra).collect()}
    assert texts[1, 0] == (None, None) and texts[1, 2] == ("user", "") and texts[4, 1] == ("us", "er")
    assert trie.trie(extra.limit(0)).count() == 0
    assert found(trie.trie(extra.limit(0), spark.createDataFrame([(7,), (None,)], "conv long"))) == list(plain({7: []}))


def test_queue_spills_and_keeps_order():
    rng, queue, sent = random.Random(5), trie.Messages(7), {}
    for _ in range(5000):
        at = rng.randint(0, 300)
        queue.push(at, (at, 1))
        sent[at] = sent.get(at, 0) + 1
    assert queue.made > trie.FILES and {at: sum(n for _, n in queue.pop(at)) for at in range(301)} == {at: sent.get(at, 0) for at in range(301)}
    assert not len(queue)


def test_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(8)
    turns = {c: [(rng.choice([None, "user"]), rng.choice(["q", "w", None, "long text"])) for _ in range(rng.randint(1, 7))] for c in [0, 300, *rng.sample(range(1, 300), 120)]}
    rows = [(c, None if i == 0 and c % 3 == 0 else i, *t) for c, ts in turns.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    spark.createDataFrame([*rows, (None, 1, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    full = {c: [(r or "", t or "") for r, t in ts] for c, ts in turns.items()}
    want = {}
    for c, ts in full.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = full.get(c - c % 100, [])[:h] + ts[h:]
    assert sorted(found(queries.op11_prefix_trie(spark, str(tmp_path))), key=repr) == sorted(plain(want), key=repr)
