"""Toxicity by multiple-instance learning: labels are on documents, scores are on sentences.

A sentence is toxic with the logistic probability of the weights of its different words, where a
word has a weight of its own and those of its beginnings (so inflected forms share one); a document
is toxic unless none of its sentences is (noisy-or). Weights and bias are fitted to document labels
through that formula, on a bounded sample of labelled documents on the driver; all documents are
then scored in batches inside tasks. The same weights point at the sentences that made the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample that the model is fitted on, and how many of its characters are taken at most.
SAMPLE_ROWS, SAMPLE_CHARS = 5000, 40_000_000
#: A word counts from so many sampled documents on, and if its share among toxic documents differs
#: from that among others by so many standard errors.
LEAST_DOCS, LEAST_ERRORS = 5, 4.0
STEPS, RATE, SHRINK = 100, 0.2, 5e-4
SENTENCES, WORDS = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    return word, *("^" + word[:n] for n in (4, 5))


class _Weights(dict):
    """Summed weight of each word met so far; forgets all when it has grown long."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """score(text): log(1 - p) summed over the sentences of a text in lower case."""
        words, blank = _Weights(self.weights), _softplus(self.bias)

        def clean(text: str) -> float:
            out = 0.0
            for s in SENTENCES.findall(text):
                known = [x for x in map(words.__getitem__, sorted(set(WORDS.findall(s)))) if x]
                if known:
                    out -= _softplus(self.bias + sum(known))
                elif not s.isspace():
                    out -= blank
            return out

        return clean

    def scores(self, texts) -> list[float]:
        """Probability that each document is toxic; 0 without any sentence, as for null and empty."""
        clean = self.scorer()
        return [max(0.0, -math.expm1(clean((t or "").lower()))) for t in texts]


def _softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _bags(text: str | None) -> list[list[str]]:
    """The different words of each sentence."""
    return [sorted(set(WORDS.findall(s))) for s in SENTENCES.findall((text or "").lower()) if s.strip()]


def _errors(n: int, n_toxic: int, docs: int, toxic: int) -> float:
    share, rest = n / docs, docs - toxic
    return abs(n_toxic / toxic - (n - n_toxic) / rest) / math.sqrt(max(share * (1 - share), 1 / docs) * (1 / toxic + 1 / rest))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Weights by proximal Adam on the mean log loss of the noisy-or; words of no use get weight 0
    and are left out. Without both labels the model knows no words and calls nothing toxic."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model({}, 20.0 if labels and labels[0] else -20.0)
    seen, toxic = Counter(), Counter()
    for text, label in zip(texts, labels):  # twice over the texts, so that their words are never all held
        found = {f for s in _bags(text) for w in s for f in features(w)}
        seen.update(found)
        if label:
            toxic.update(found)
    known = sorted(f for f, n in seen.items() if n >= LEAST_DOCS and _errors(n, toxic[f], len(labels), sum(labels)) >= LEAST_ERRORS)
    del seen, toxic
    vocabulary = {f: i for i, f in enumerate(known)}
    counts, sizes, columns = [], [], []
    for text in texts:
        bags = [[vocabulary[f] for w in s for f in features(w) if f in vocabulary] for s in _bags(text)]
        counts.append(len(bags))
        sizes += map(len, bags)
        columns += (i for bag in bags for i in bag)
    doc, row, col = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(sizes)), sizes), np.array(columns, np.int64)
    n, k = len(counts), len(vocabulary)
    w, b = np.zeros(k), -4.0
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, w[col], len(sizes))
        clean = np.bincount(doc, -np.logaddexp(0, z), n)  # log of the chance that no sentence is toxic
        clean = np.minimum(clean, -1e-9)
        slope = np.where(y == 1, 1 / np.expm1(-clean), -1.0) / n  # of the loss, by the log of that chance
        inner = -slope[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(col, inner[row], k), inner.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK / (np.sqrt(square[:-1] / (1 - 0.99 ** step)) + 1e-3), 0)
        b = b - move[-1]
    kept = {x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 0.05}
    return Model(kept, float(b))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a null id has no label and is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``most_rows`` labelled documents, chosen by a hash of the id.

    Only the chosen ids are broadcast, so no text is shuffled. Null ids and labels are not learnt
    from; a document with several labels, and each row of an id that is repeated, counts once for
    each. A text longer than a hundredth of ``most_chars`` is passed over, alone; the others are
    taken in the order of the hash while they fit. If the labels that may be learnt from are of
    both kinds but the texts taken are not, there is nothing to tell them apart by, which is an error.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    order = [F.xxhash64("__id"), "__id", "__toxic"]
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).join(
        F.broadcast(known.orderBy(*order).limit(most_rows)), "__id")
    size = F.coalesce(F.length("__text"), F.lit(0))
    taken = F.sum("__size").over(Window.orderBy(*order, "__size").rowsBetween(Window.unboundedPreceding, 0))
    fitting = rows.withColumn("__size", size).where(F.col("__size") <= max(1, most_chars // 100)).orderBy(*order, "__size").limit(most_rows)
    found = fitting.withColumn("__taken", taken).where(F.col("__taken") <= most_chars).select("__text", "__toxic").toPandas()
    seen = found["__toxic"].tolist()
    if len(set(seen)) < 2:
        there = known.join(docs.select(F.col("doc_id").alias("__id")), "__id", "left_semi").agg(F.min("__toxic"), F.max("__toxic")).first()
        if there[0] != there[1]:
            raise ValueError(f"documents carry labels of both kinds, but the sample of {len(seen)} texts does not: raise its bounds")
    return fit(found["__text"].tolist(), seen)


def score(text: Column, model: Model) -> Column:
    """Score of each whole text, from 0 to 1."""
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), dtype="float64")

    return scores(text.cast("string"))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), sentence and its score, for sentences from ``least`` on."""
    @F.pandas_udf("array<struct<start:int,end:int,sentence:string,score:double>>")
    def find(texts: pd.Series) -> pd.Series:
        out, clean = [], model.scorer()
        for text in texts:
            rows = []
            for m in SENTENCES.finditer(text or ""):
                p = -math.expm1(clean(m[0].lower()))
                if m[0].strip() and p >= least:
                    rows.append({"start": m.start(), "end": m.end(), "sentence": m[0], "score": p})
            out.append(rows)
        return pd.Series(out)

    return docs.select("doc_id", F.explode(find(F.col("text").cast("string"))).alias("s")).select("doc_id", "s.*")
