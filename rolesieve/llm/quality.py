"""Quality rules as a short-circuit cascade; DataFrame functions only.

Measures of a text are worked out once. Rules on top of them are tried on a bounded sample; the one
that rejects most sample rows for its cost comes first, then the one that rejects most of the rest,
and so on. Cost is what a rule has to read of the rows that reach it, so it is the same on every
machine and in every run. A row stops at the first rule that rejects it. The order changes what a row
costs, never what is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import WORD, let

#: Bound of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 2000
#: What a rule costs on a row before it reads any text, in characters read.
FIXED_COST = 16
WINDOW = 3
SPACE, SYMBOL = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the measures and ``text``; null counts as not rejected."""

    name: str
    rejects: str

    @property
    def passes(self) -> int:
        """How often the rule reads a text."""
        return len(re.findall(r"\btext\b", self.rejects))


#: Production rules. They are wide of what running text in any language looks like.
RULES = (
    Rule("symbols", "n_symbols > 0.5 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", r"2 * regexp_count(text, '\\p{Lu}') > word_chars"),
    Rule("letters", r"2 * regexp_count(text, '\\p{L}') < word_chars"),
    Rule("marks", r"2 * regexp_count(text, '[!?]') > n_words"),
)


def repeated_words(words: Column) -> Column:
    """Words inside a window of three that occurs at least twice in the text. Windows are compared
    by 64-bit hashes within one text."""
    def windows(h):
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    def covered(g):
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(by_hash, lambda p: let(F.sort_array(F.transform(F.filter(
            p, lambda x, k: F.get(p, k - 1)["g"].eqNullSafe(x["g"]) | F.get(p, k + 1)["g"].eqNullSafe(x["g"])), lambda x: x["i"])), union))

    def union(starts):
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct(
            (s["n"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))))


def measured(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """__doc (the input row as a struct), text and its measures. Null is the empty text; nothing of
    a long one is left out; a text without words has measures of 0."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__doc"), text.alias("text"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    lines = let(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    words = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    return rows.select("*", words.alias("__w"), lines.alias("__l"), (F.length("text") - count(SPACE)).cast("long").alias("word_chars"), count(SYMBOL).alias("n_symbols")).select(
        "__doc", "text", "word_chars", "n_symbols", "__w.*", "__l.*")


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def cascade(rows: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` in the order of rejections per cost on a sample of ``rows``.

    Both are counted over the sample rows that no earlier rule has taken: a rule costs what it reads
    of them, characters times passes, and FIXED_COST a row. Of equal rules the first comes first, so
    without rows the order stays. At most ``sample_rows`` rows of a size and a flag for each rule
    come to the driver.
    """
    left = rows.select(F.coalesce(F.length("text"), F.lit(0)).alias("__size"), *(
        F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"__{i}") for i, r in enumerate(rules))).limit(sample_rows).collect()
    order, rest = [], list(range(len(rules)))
    while rest:
        chars = sum(row[0] for row in left)
        best = max(rest, key=lambda i: (sum(row[i + 1] for row in left) / (FIXED_COST * len(left) + rules[i].passes * chars or 1), -i))
        order.append(rules[best])
        left = [row for row in left if not row[best + 1]]
        rest.remove(best)
    return order


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows from everywhere in ``docs``, never more."""
    n = docs.count()
    return docs.sample(min(1.0, 1.2 * rows / n), seed).limit(rows) if n else docs


def judge(docs: DataFrame, text: Column | str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of every row with base_failed and kept (no base failure, and no rule rejects)."""
    order = cascade(measured(sampled(docs), text), rules)
    rows = measured(docs, text).withColumn("base_failed", F.expr(BASE_FAILED))
    kept = F.when(F.col("base_failed"), False)
    for rule in order:
        kept = kept.when(F.expr(rule.rejects), False)
    return rows.withColumn("kept", kept.otherwise(True)).drop("text")
