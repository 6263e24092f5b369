"""Repeated passages against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesieve.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts):
    words = [WORD.findall(t or "") for t in texts]
    grams = [[tuple(w[i:i + 35]) for i in range(len(w) - 34)] for w in words]
    times = Counter(g for gs in grams for g in gs)
    out = []
    for w, gs in zip(words, grams):
        gone = {i + k for i, g in enumerate(gs) if times[g] > 1 for k in range(35)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def prose(seed, n, letters="abcdefgh", longest=6):
    rng = random.Random(seed)
    return [("".join(rng.choices(letters, k=rng.randint(1, longest)))) for _ in range(n)]


def corpus():
    rng = random.Random(3)
    base = [prose(i, 400) for i in range(14)]
    common = prose(99, 60)
    texts = [" ".join(b) for b in base]
    for n in (34, 35, 36, 50, 69, 70, 120):  # passages of every length around the limit, at edges and inside
        a, b = base[n % 14][10:10 + n], prose(n, 50)
        texts += [" ".join(a + b), " ".join(b + ["x"] + a), " ".join(b[:20] + a + b[20:])]
    texts += [" ".join(prose(200 + i, rng.randint(0, 40)) + common + prose(300 + i, rng.randint(0, 40))) for i in range(40)]  # one passage everywhere
    for i in range(25):  # near copies: a word changed here and there
        copy = list(base[i % 3])
        for at in rng.sample(range(400), rng.randint(1, 9)):
            copy[at] = f"new{rng.random()}"
        texts.append("\t ".join(copy))
    texts += [texts[5]] * 30  # a group of exact copies
    texts += ["a " * 34, "a " * 35, "a " * 36, "b " * 500, "a b " * 300, "a a b " * 90, " ".join(prose(7, 200, "ab", 1)), " ".join(prose(8, 300, "ab", 1))]
    own = prose(44, 80)
    texts += [" ".join(own + ["mid"] + own), "", None, " \n\t", "one", "é ü " * 40 + "end", "É" * 100_000]
    return texts


@pytest.fixture(params=[{}, {"STEP": 64, "TEXT_STEP": 50}], ids=["whole", "steps"])
def steps(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(substrings, name, value)


def test_segments_find_what_brute_force_finds(steps):
    """The parse without Spark: equal segments and windows at edges cover the repeated windows."""
    texts = [t or "" for t in corpus()]
    hashes = [substrings.word_hashes(t.encode()) for t in texts]
    assert [len(h) for h in hashes] == [len(WORD.findall(t)) for t in texts]
    rows = [(d, int(f), int(e), int(k), int(x)) for d, h in enumerate(hashes) for fs, es, ks, xs in substrings.segments(h) for f, e, k, x in zip(fs, es, ks, xs)]
    for d, h in enumerate(hashes):  # each window in one segment
        mine = sorted((f, e) for n, f, e, _, _ in rows if n == d)
        assert [i for f, e in mine for i in range(f, e + 1)] == list(range(max(0, len(h) - 34)))
    times = Counter((k, x) for *_, k, x in rows)
    looked = [(d, int(s), k, int(w)) for d, f, e, k, _ in rows for s, w in zip(*substrings.windows(hashes[d], np.array([f]), np.array([e])))]
    same = Counter((k, w) for *_, k, w in looked)
    for d, (n, removed, _, kept) in enumerate(plain(texts)):
        ats = [f << 8 | e - f for m, f, e, k, x in rows if m == d and times[k, x] > 1] + [s << 8 for m, s, k, w in looked if m == d and same[k, w] > 1]
        assert int(substrings.covered(n, ats).sum()) == removed and substrings._cleaned(texts[d].encode(), ats) == (kept,)
        assert sum(b - a for a, b in substrings.spans(n, ats)) == removed


def test_factors_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x", "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, a long, b string, at string, key string")
    docs = docs.withColumn("__n", F.lit(0)).repartition(5)
    found = substrings.Factors(docs, carry=F.struct("doc_id", "text"))
    want = Counter((i if i % 9 else None, *p[:3]) for i, p in enumerate(plain(texts)))
    assert Counter((r["__doc"].doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.counts().collect()) == want
    assert Counter(r.kept for r in found.kept().collect()) == Counter(p[3] for p in plain(texts))
    assert Counter(sum(s.end - s.first for s in r.spans) for r in found.spans().collect()) == Counter(p[1] for p in plain(texts))
    assert substrings.Factors(docs).spans().select("__doc.*").columns == docs.columns
    assert substrings.Factors(docs.limit(0)).counts().count() == 0


def test_copies_are_read_once(spark, monkeypatch):
    """Windows looked at around a changed word do not grow with the copies of a text, let alone by their square."""
    texts = []
    for i in range(8):
        words = prose(500 + i, 120)
        texts += [" ".join(words)] * 40 + [" ".join(words[:60] + ["changed"] + words[61:])]
    written, stored = [], substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda df: written.append(stored(df)) or written[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = substrings.Factors(docs, carry=F.struct("doc_id")).counts()
    assert Counter((r["__doc"].doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == Counter((i, *p[:3]) for i, p in enumerate(plain(texts)))
    looked = [df for df in written if "open" in df.columns]
    assert len(looked) == 1 and 0 < looked[0].count() <= len(set(texts)) * (120 - 34)
