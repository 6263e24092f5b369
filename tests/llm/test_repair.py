"""Structure repair against brute force over all edit sequences, in one piece and in many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rolesieve.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired turns) by trying everything: a way is (cost, audit, role initials, turns)."""
    ways = {(0, "", "", ())}
    legal = re.compile(r"(s?((ua)*u?)?)")
    for (role, text), fault in zip(rows, faults(rows)):
        new = set()
        for cost, audit, initials, turns in ways:
            for n in range(3):
                for more in {0: [()], 1: [("user",), ("assistant",)], 2: [("user", "assistant"), ("assistant", "user")]}[n]:
                    base = initials + "".join(r[0] for r in more)
                    head = (cost + 5 * n, audit + "I" * n, base, turns + tuple(r + ":" for r in more))
                    new.add((head[0] + 2, head[1] + "D", base, head[3]))
                    if fault not in ("blank", "duplicate"):
                        late = 5 * (fault == "truncated")
                        if role:  # a role without an initial is never kept
                            new.add((head[0] + late, head[1] + "K", base + role[:1], head[3] + (f"{role}:{text}",)))
                        for r in ("user", "assistant"):
                            new.add((head[0] + late + 1, head[1] + "R", base + r[0], head[3] + (f"{r}:{text}",)))
        new = {w for w in new if legal.fullmatch(w[2])}
        cheapest = {}
        for w in new:
            cheapest[w[2]] = min(cheapest.get(w[2], w), w)
        # what follows depends on the last initial alone; the least way of each stays
        by_end = {}
        for w in cheapest.values():
            end = w[2][-1:]
            by_end.setdefault(end, []).append(w)
        ways = {min(g) for g in by_end.values()}
    final = []
    for cost, audit, initials, turns in ways:
        for n, more in ((0, ()), (1, ("user",)), (1, ("assistant",)), (2, ("user", "assistant")), (2, ("assistant", "user"))):
            if re.fullmatch(r"(s?(ua)+)?", initials + "".join(r[0] for r in more)):
                final.append((cost + 5 * n, audit + "I" * n, turns + tuple(r + ":" for r in more)))
    return min(final)


def report(rows):
    """``rows``: (turn, role, text) in order."""
    said = [r[1:] for r in rows]
    found, numbers = faults(said), [t for t, _, _ in rows if t is not None]
    cost, audit, turns = plain(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def conversation(rng, longest):
    role = lambda: rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", " "])
    text = lambda: rng.choice(["Yes.", "No!", "cut off", "", " \t", "What? ", "x."])
    rows = [(rng.choice([None, rng.randint(0, 12)]), role(), text() if rng.random() < 0.7 else f"{rng.random()}.") for _ in range(rng.randint(1, longest))]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("rows", [2000, 3, 1])
def test_repair_against_brute_force(spark, rows):
    rng = random.Random(4)
    talks = {c: conversation(rng, 12 if c % 5 else 40) for c in range(120)}
    table = [(c, *t) for c, ts in talks.items() for t in ts]
    rng.shuffle(table)
    fixed = repair.Repair(spark.createDataFrame(table, TURNS).withColumns({"key": F.lit(1), "seen": F.lit("x"), "place": F.lit(0)}), rows=rows)
    reports = got(fixed.reports())
    assert reports == {c: report(ts) for c, ts in talks.items()}
    edits = {}
    for r in sorted(fixed.edits().collect(), key=lambda r: (r.conv_id, r.piece, r.at)):
        edits.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for c, r in reports.items():
        assert "".join(e for e, _, _ in edits[c]) == r[6]
        kept = "\n".join(f"{role}:{text}" for e, role, text in edits[c] if e != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == r[7]


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (1, None, None, "a."), (2, 5, "user", None), (3, 1, "user", "x" * 300_000), (3, 2, "assistant", "y." * 200_000)]
    out = got(repair.Repair(spark.createDataFrame(rows, TURNS)).reports())
    assert out[None] == report([(None, " ", " "), (1, "user", "Hi.")]) and out[1] == report([(None, " ", "a.")])
    assert out[2] == report([(5, "user", " ")]) and out[3] == report([(1, *rows[4][2:]), (2, *rows[5][2:])])
    assert got(repair.Repair(spark.createDataFrame(rows, TURNS), rows=1).reports()) == out
    empty = repair.Repair(spark.createDataFrame([], TURNS))
    assert empty.reports().count() == empty.edits().count() == 0


def test_survivors_emit_early_and_stay_few():
    rng, search, writer = random.Random(1), repair.Survivors(), repair.Writer()
    most, done, fed = 0, 0, []
    for i in range(6000):
        role, fault = rng.choice(["user", "assistant"]), rng.choice([repair.FINE] * 6 + [repair.CUT, repair.MUST_GO])
        fed.append(role)
        writer.take(role, str(i))
        done += sum(1 for e, *_ in writer.write(search.row(role[0], fault)) if e != "I")
        most = max(most, search.size())
    assert done > 5900 and most < 120 and len(writer.waiting) == 6000 - done
    search = repair.Survivors()
    for _ in range(500):  # a run of one role: ties all the way
        search.row("u", repair.FINE)
    assert search.best[repair.ASSISTANT][0] == 250 and search.size() <= 2000


def test_query_damages_and_reports_all(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, None if i == 0 and (c or 0) % 7 == 0 else i, rng.choice(["user", "assistant", "system", None]), rng.choice(["One. Two?", "Three", None, "Four!"])) for c in [*range(150), None] for i in range(rng.randint(1, 9))]
    rows.append((next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0), 1, "user", "Gone."))
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: [] for c, *_ in rows}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want[c] += [] if fault == 0 else [row] * (1 + (fault == 3))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(queries.op13_structure_repair(spark, str(tmp_path))) == {c: report(ts) if ts else empty for c, ts in want.items()}
    assert empty in got(queries.op13_structure_repair(spark, str(tmp_path))).values()
