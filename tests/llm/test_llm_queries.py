"""The registered queries and the pipeline on the smallest shared tables."""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections import Counter
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolesieve.llm import mixing, packing, secrets, simhash, toxicity
from rolesieve.llm.oracles import ORACLES
from rolesieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # where every status comes up, and the model finds words

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the shared test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name,columns", [
    ("op1_tool_calls", 10), ("op8_toxicity", 4), ("op9_packing", 7), ("op10_simhash", 3),
])
def test_query_runs(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == columns and df.count() > 0


def test_op1_against_plain_python(spark):
    """Statuses, places in the order and lines, from the turns alone."""
    turns = [r for r in spark.read.parquet(f"{LARGER}/conversations.parquet").collect()]
    assert all(None not in (r.conv_id, r.turn, r.role, r.text) for r in turns) and not any('"$ref:' in r.text for r in turns)
    calls, answers, want = {}, {}, []
    for r in turns:
        if r.role == "assistant":
            n = len(r.text)
            other = r.turn + 2 if n % 5 == 0 else r.turn - 2 if r.turn >= 3 else None
            arguments = {"text": r.text, "limit": n % 50, **({"after": f"$ref:{r.conv_id}-{other}"} if other is not None else {})}
            tool = ("search", "fetch", "store")[n % 3]
            wrong = (n < 20 or n % 50 > 45) if tool == "search" else tool == "store" and n % 50 < 3
            key = r.conv_id, f"{r.conv_id}-{r.turn}"
            assert key not in calls
            calls[key] = r.turn, tool, arguments, wrong, None if other is None else (r.conv_id, f"{r.conv_id}-{other}")
        elif r.role == "user":
            answers.setdefault((r.conv_id, f"{r.conv_id}-{r.turn - 1}"), []).append((r.turn, r.text))

    def label(key, above=()):
        """(at, step) of a call; None in or behind a cycle."""
        pos, *_, ref = calls[key]
        if key in above:
            return None
        if ref not in calls:
            return pos, 0
        behind = label(ref, (*above, key))
        return behind and max((pos, 0), (behind[0], behind[1] + 1))

    for key, (pos, tool, arguments, wrong, ref) in calls.items():
        place, answer = label(key), min(answers.get(key, [(None, None)]))
        status = "invalid" if wrong else "missing_reference" if ref is not None and ref not in calls else "cycle" if place is None \
            else "no_result" if key not in answers else "ok"
        line = {"id": key[1], "name": tool, "arguments": arguments, "result": answer[1], "status": status}
        want.append((*key, pos, answer[0], tool, status, *(place or (None, None)), json.dumps(line, sort_keys=True)))
    for key, found in answers.items():
        for turn, text in sorted(found)[key in calls:]:
            status = "repeated_result" if key in calls else "orphan_result"
            line = {"id": key[1], "name": None, "arguments": None, "result": text, "status": status}
            want.append((*key, None, turn, None, status, None, None, json.dumps(line, sort_keys=True)))
    got = [(r.conv_id, r.call_id, r.call_pos, r.result_pos, r.name, r.status, r.order_at, r.order_step, json.dumps(json.loads(r.json), sort_keys=True))
           for r in QUERIES["op1_tool_calls"](spark, LARGER).collect()]
    assert Counter(got) == Counter(want)
    assert {"ok", "invalid", "cycle", "missing_reference", "no_result"} & {w[5] for w in want} >= {"ok", "invalid", "cycle"}


def test_op8_scores_are_the_noisy_or_of_sentences(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{LARGER}/documents.parquet"), labels)
    assert model.weights

    def chance(sentence):
        words = set(toxicity.WORDS.findall(sentence))
        z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        return 1 / (1 + math.exp(-z))

    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, LARGER).collect()}
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        sentences = [x for x in toxicity.SENTENCES.findall((d.text or "").lower()) if x.strip()]
        score = 1 - math.prod(1 - chance(x) for x in sentences)
        r = got[d.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    judged = [r for r in got.values() if r.held_out and r.doc_id in toxic]
    assert judged and sum(r.predicted == toxic[r.doc_id] for r in judged) >= 0.9 * len(judged)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)

    clean = stages[0](spark, docs, SF)
    scores = dict(docs.select("doc_id", toxicity.score(F.col("text"), model)).collect())
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}

    single = stages[1](spark, clean, SF)
    rows = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in clean.collect())
    parent = {i: i for i, _ in rows}
    for (i, x), (j, y) in itertools.combinations(rows, 2):  # brute force: all pairs
        if (x ^ y).bit_count() <= 2 and parent[i] != parent[j]:
            low, high = sorted((parent[i], parent[j]))
            parent = {k: low if p == high else p for k, p in parent.items()}
    assert len(set(parent.values())) < len(rows)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(set(parent.values()))

    safe = stages[2](spark, single, SF)
    assert safe.columns == docs.columns and safe.count() == single.count()
    assert secrets.Scan(safe, F.col("text"), [F.col("doc_id")]).by_row().where(F.size("spans") > 0).count() == 0

    mixed = stages[3](spark, safe, SF)
    copies = {r["__doc"].doc_id: r.copies for r in mixing.mix(safe)[0].collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counts == {i: n for i, n in copies.items() if n}

    packed = stages[4](spark, mixed, SF).collect()
    tokens = {r.doc_id: len(packing.token_ids(r.text, packing.public_path("byte_bpe_50k.tiktoken"))) for r in mixed.collect()}
    assert sum(r.length for r in packed) == sum(tokens[i] * n for i, n in counts.items())
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.start, r.length) for r in packed)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, columns with clashing names, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __score double, code long, size long"
    rows = [(i, f"plain words of row {i} and nothing else", "en", "ab"[i % 2], 1, "x", 0.9, 1, 2) for i in range(6)]
    rows += [rows[0], rows[0], (None,) * 9, (7, None, None, None, None, None, None, None, None), (8, "", "en", None, 0, "", 0.0, 0, 0), (None, "a text without an id", "en", "a", 1, "x", 0.1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.where("start = 0").count() == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = Counter(tuple(r) for r in out.collect())
        if name in ("toxicity", "secret scan"):
            assert got == Counter(rows), name
        elif name == "simhash near-dedup":
            texts = [r[1] for r in got]
            assert set(got.values()) == {1} and len([t for t in texts if not t]) == 1 and len(set(texts)) == len(texts)
        else:
            assert set(got) <= set(rows) and all(n <= 3 * Counter(rows)[r] for r, n in got.items())
