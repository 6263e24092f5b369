"""Secrets in texts, found through an inverted trigram index; DataFrame functions only.

Every rule is a regular expression. From it a Boolean query over trigrams is derived on the driver:
what any match must contain. The index lists, in blocks of some thousand distinct texts, which texts
hold each trigram that some query names; queries intersect and unite these postings, and only their
candidates are verified with the expressions. A rule without mandatory trigrams scans every text.

The first pass reads all texts and keeps a digest, the trigrams found and the spans of scanning
rules, no text. The second pass shuffles the texts that hold, for some way of matching a rule, its
rarest trigram: a few percent of all, and copies only once for each task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import let, stored

#: Distinct texts of a block of postings.
BLOCK = 4096
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads the same in Java, Python and RE2; a match counts if its ``group`` has
    ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, then public key formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ with 16 characters or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    # headers of 1,000 characters at most: without a bound, a run of eyJ costs its length squared
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # schemes of 31 characters at most: without a bound, long runs of letters cost their length squared
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
BASE = 3

# A query is a trigram, ("and", queries), ("or", queries), or None where any text may match.


def both(kind: str, queries: list):
    if kind == "or" and None in queries:
        return None
    flat = [q for x in queries if x is not None for q in (x[1] if x[0] == kind else (x,))]
    queries = list(dict.fromkeys(flat))
    if kind == "or":  # what holds whenever a wider clause holds adds nothing
        sets = {q: set(q[1]) if q[0] == "and" else {q} for q in queries}
        queries = [q for q in queries if not any(sets[o] < sets[q] for o in queries)]
    return queries[0] if len(queries) == 1 else (kind, tuple(queries)) if queries else None


def trigram_query(pattern: str):
    """What a text, in lower case, must contain for ``pattern`` to match."""
    return _sequence(regex_parser.parse(pattern))


def _sequence(nodes):
    parts, run = [], {""}
    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= 64:
            run = {a + b for a, b in product(run, strings)}
            continue
        parts += [_literal(run), _nested(node)]
        run = strings if strings is not None and len(strings) <= 64 else {""}
    return both("and", [*parts, _literal(run)])


def _literal(strings):
    return both("or", [
        both("and", [s[i:i + 3].lower() for i in range(len(s) - 2)]) if len(s) > 2 else None for s in sorted(strings)])


def _nested(node):
    op, value = str(node[0]), node[1]
    if op == "SUBPATTERN":
        return _sequence(value[-1])
    if op == "BRANCH":
        return both("or", [_sequence(x) for x in value[1]])
    if op == "MAX_REPEAT" and value[0] >= 1:
        return _sequence(value[2])
    return None


def _strings(node) -> set[str] | None:
    """All strings that a part of an expression matches, if they are few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op == "IN":
        chars = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op == "SUBPATTERN":
        return _concat(value[-1])
    if op == "BRANCH":
        found = [_concat(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if op == "MAX_REPEAT" and value[1] <= 3:
        inner = _concat(value[2])
        return None if inner is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(inner, repeat=n)}
    return None


def _concat(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        strings = _strings(node)
        if strings is None or len(out) * len(strings) > 64:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def rarest(query, frequency: dict[str, int]) -> set[str]:
    """Trigrams one of which every text holds that ``query`` accepts, chosen for few texts."""
    if isinstance(query, str):
        return {query}
    found = [rarest(q, frequency) for q in query[1]]
    cost = lambda names: sum(frequency.get(t, 0) for t in names)
    return set().union(*found) if query[0] == "or" else min(found, key=lambda x: (cost(x), sorted(x)))


def _postings(query, index: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(index, F.lit(query)), F.array().cast("array<string>"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(join, [_postings(q, index) for q in query[1]])


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """All matches of ``rule`` in ``text``, leftmost and apart; places count code points."""
    none = F.array().cast(SPANS)
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("b"), whole.alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"))

    def step(state, x):
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = F.when(F.length(x["g"]) >= rule.least, F.concat(state["out"], span)).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.cast(SPANS).alias("out"))

    # the piece after the last match has no match of its own
    found = F.aggregate(F.filter(zipped, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _all_spans(text: Column, rules: dict[int, Rule], only: Column | None = None) -> Column:
    none = F.array().cast(SPANS)
    parts = [spans(text, r, k) if only is None else F.when(F.array_contains(only, k), spans(text, r, k)).otherwise(none) for k, r in rules.items()]
    return F.concat(none, *parts)


class Scan:
    """Secrets of ``docs``: texts are ``text`` (null: empty), results are by ``digest`` of a text.

    ``rows`` has one row per input row with the columns ``carry`` and __digest; ``found`` has
    __digest and spans (by start, then kind) for every different text with a secret. Repeated rows
    and copies share a digest; an empty table finds nothing; other columns are not looked at.
    """

    def __init__(self, docs: DataFrame, text: Column, carry: list[Column], rules: tuple[Rule, ...] = RULES):
        text = F.coalesce(text.cast("string"), F.lit(""))
        queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
        self.scanned = {k: r for k, r in enumerate(rules) if queries[k] is None}
        self.indexed = {k: r for k, r in enumerate(rules) if queries[k] is not None}
        names = sorted(set().union(*(trigrams(q) for q in queries.values())))
        self.text, self.rules = text, rules

        def present(lower):
            return F.filter(F.array(*map(F.lit, names)), lambda t: F.contains(lower, t))

        self.rows = stored(docs.select(
            *carry, F.md5(text).alias("__digest"),
            (let(F.lower(text), present) if names else F.array().cast("array<string>")).alias("__trigrams"),
            _all_spans(text, self.scanned).alias("__spans")))
        index = self.index = stored(self._index(self.rows))
        frequency = {t: n for t, n in index.groupBy("trigram").agg(F.sum(F.size("texts"))).collect()}  # a row per trigram of a rule
        self.anchors = sorted(set().union(*(rarest(queries[k], frequency) for k in self.indexed)))

        blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("index"))
        candidates = blocks.select(F.explode(F.concat(F.array().cast("array<struct<t:string,k:int>>"), *(
            self._candidates(k, queries[k]) for k in self.indexed))).alias("c")).groupBy(F.col("c.t").alias("__digest")).agg(F.collect_set("c.k").alias("__rules"))
        texts = docs.where(self._anchored()).select(F.md5(text).alias("__digest"), text.alias("__text")).groupBy("__digest").agg(F.first("__text").alias("__text"))
        verified = texts.join(candidates, "__digest").select("__digest", _all_spans(F.col("__text"), self.indexed, F.col("__rules")).alias("__spans"))
        scanned = self.rows.where(F.size("__spans") > 0).groupBy("__digest").agg(F.first("__spans").alias("__spans"))
        self.rows = self.rows.drop("__trigrams", "__spans")
        self.found = stored(
            verified.where(F.size("__spans") > 0).unionByName(scanned).groupBy("__digest")
            .agg(F.sort_array(F.flatten(F.collect_list("__spans"))).alias("spans")))  # two rows at most

    @staticmethod
    def _candidates(kind: int, query) -> Column:
        return F.transform(_postings(query, F.col("index")), lambda t: F.struct(t.alias("t"), F.lit(kind).alias("k")))

    @staticmethod
    def _index(rows: DataFrame) -> DataFrame:
        """Postings: block, trigram, and the digests of the block's texts that hold the trigram."""
        blocks = max(1, -(-rows.count() // BLOCK))
        block = F.pmod(F.xxhash64("__digest"), F.lit(blocks)).alias("block")
        return rows.select(block, "__digest", F.explode("__trigrams").alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("__digest").alias("texts"))

    def _anchored(self) -> Column:
        lower = F.lower(self.text)
        return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(t)) for t in self.anchors], F.lit(False))

    def by_row(self) -> DataFrame:
        """The carried columns and spans of every input row; no spans give an empty array."""
        return self.rows.join(self.found, "__digest", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))).drop("__digest")


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets, and n_chars, where
    there is such a column, set to the new length. Rows without secrets pass as they are."""
    scan = Scan(docs, F.col("text"), [], rules)
    kinds = F.array(*(F.lit(f"[{r.kind}]") for r in rules))
    text = F.col("__text")

    def step(state, s):
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        new = F.concat(state["out"], kept, F.get(kinds, s["kind"]))
        at = F.greatest(state["at"], s["end"])
        return F.when(s["start"] >= state["at"], F.struct(at.alias("at"), new.alias("out"))).otherwise(F.struct(at.alias("at"), state["out"].alias("out")))

    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    # only texts that can hold a secret meet the spans
    possible = scan._anchored() | reduce(lambda a, b: a | b, [scan.text.rlike(r.pattern) for r in scan.scanned.values()], F.lit(False))
    rows = docs.where(possible).select(F.struct("*").alias("__doc"), scan.text.alias("__text"), F.md5(scan.text).alias("__digest"))
    joined = rows.join(scan.found, "__digest", "left")
    new = F.when(F.col("spans").isNull(), F.col("__doc.text")).otherwise(cut)
    columns = [new.alias(c) if c == "text" else F.when(F.col("spans").isNull(), F.col("__doc.n_chars")).otherwise(F.length(cut)).cast("long").alias(c) if c == "n_chars" else F.col("__doc").getField(c).alias(c) for c in docs.columns]
    return docs.where(~possible).unionByName(joined.select(*columns))
