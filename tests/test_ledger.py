"""Replies are kept as they come: what was asked is counted over failed tasks and repeated runs."""

import os

import pytest

from rolesieve.operators import scoring

REQS = "seq long, system_prompt string, user_prompt string"


def requests(spark, n, text="ask"):
    return spark.createDataFrame([(i, "judge", f"{text} {i}") for i in range(n)], REQS)


def logged(folder, die_at=None):
    """A scorer that writes each call down, and once ends its worker at one request."""
    def scorer(system_prompt, user_prompt):
        with open(f"{folder}/calls", "a") as f:
            f.write(user_prompt + "\n")
        if user_prompt == die_at and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        if user_prompt.endswith("7"):
            raise scoring.ScoringError("no", "RateLimitError", attempts=7)
        return {"score": len(user_prompt), "rationale": "r"}

    return scorer


def calls(folder):
    return (folder / "calls").read_text().splitlines()


def test_a_lost_task_costs_its_chunks_only(spark, tmp_path):
    n, chunk, threads = 240, 10, 4
    reqs, ledger = requests(spark, n), f"file://{tmp_path}/ledger"
    with pytest.raises(Exception):
        scoring.score(reqs, logged(tmp_path, die_at="ask 201"), ledger=ledger, chunk_rows=chunk).count()
    before = len(calls(tmp_path))
    kept = spark.read.schema(scoring.LEDGER_SCHEMA).parquet(ledger).count()
    assert 0 < kept < n and before - kept <= threads * chunk
    rows = scoring.score(reqs, logged(tmp_path, die_at="ask 201"), ledger=ledger, chunk_rows=chunk).collect()
    assert sorted(r.seq for r in rows) == list(range(n)) and sum(r.error_type == "RateLimitError" and r.attempts == 7 for r in rows) == n // 10
    assert len(calls(tmp_path)) == before + n - kept <= n + threads * chunk


def test_nothing_is_asked_twice_and_changed_texts_are(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = scoring.score(requests(spark, 50), logged(tmp_path), max_workers=2, ledger=ledger, chunk_rows=5).collect()
    assert sorted(calls(tmp_path)) == sorted(f"ask {i}" for i in range(50))
    again = scoring.score(requests(spark, 60), logged(tmp_path), ledger=ledger, chunk_rows=5)
    assert sorted(calls(tmp_path)) == sorted(f"ask {i}" for i in range(60)) and again.count() == 60
    assert {r.seq: r.reply_json for r in first}.items() <= {r.seq: r.reply_json for r in again.collect()}.items()
    other = scoring.score(requests(spark, 3, "say"), logged(tmp_path), ledger=ledger).collect()
    assert len(calls(tmp_path)) == 63 and len(other) == 3
    assert scoring.score(requests(spark, 0), logged(tmp_path), ledger=ledger).count() == 0
