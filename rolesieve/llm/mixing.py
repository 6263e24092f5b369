"""Mixing sources to target weights, with documents that may belong to several sources.

Documents are aggregated by membership pattern (the set of their sources). A min-cost flow routes
the patterns' token capacity to the sources' quotas: a pattern gives its tokens once for free, a
second and third time at rising cost, so nothing is repeated while anything fresh is left. The flow
works on totals, a row per pattern; documents are then chosen in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.common import n_words, stored

#: Cost of the first, second and third use of a token: convex, so uses are spread evenly.
COSTS = (0, 1, 3)
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Patterns that the driver takes in; sources are the feeds of a corpus, not something that grows
#: with its documents. More is an error, never a cut.
MAX_PATTERNS = 200_000
SEED = "mix-1"
#: Documents of a bucket of the seeded order, about.
BUCKET = 200
#: Buckets that are added up together.
WIDE = 1000


def targets(sizes: list[int], weights: list[int], share: float = 1.0, most: int = len(COSTS)) -> list[float]:
    """Tokens for each source: ``share`` of all sizes by weight, no source above ``most`` times its
    own size, what is above shared again among the others. Sources of size 0 get 0."""
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), total, sum(weights)
    for at, i in enumerate(order):
        if most * sizes[i] * weight >= left * weights[i]:  # none above from here on
            for j in order[at:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = COSTS) -> list[dict[int, int]]:
    """Tokens from each pattern (its sources, its size) to each of its sources: as many as the quotas
    take, at the least cost. Cheapest paths first on the graph start - pattern - source - end.

    Only the arcs out of the start cost anything, and no shortest path comes back to it, so a path
    costs what its use of the pattern costs. Cheapest first therefore means: the largest flow with one
    use of every pattern, raised to the largest with two, and so on, as ``costs`` rise.
    """
    if list(costs) != sorted(costs):
        raise ValueError("costs must rise")
    moved = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    users: list[list[int]] = [[] for _ in quotas]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            users[s].append(p)
    spare, left = [0] * len(patterns), list(quotas)
    for _ in costs:
        for p, (sources, size) in enumerate(patterns):  # straight to quotas that still have room
            spare[p] += size
            for s in sources:
                n = min(spare[p], left[s])
                moved[p][s] += n
                spare[p] -= n
                left[s] -= n
        while _reroute(moved, users, spare, left):
            pass
    return moved


def _reroute(moved: list[dict[int, int]], users: list[list[int]], spare: list[int], left: list[int]) -> int:
    """Tokens moved along shortest ways from patterns with spare tokens to sources with room, where a
    pattern may hand on what another one gave to a source: one phase of a largest-flow search, in
    which the length of the shortest way rises. 0 if there is no way."""
    roots = [p for p, n in enumerate(spare) if n]
    depth, reached, level, ends = dict.fromkeys(roots, 0), {}, roots, False
    while level and not ends:
        sources = []
        for p in level:
            for s in moved[p]:
                if s not in reached:
                    reached[s] = depth[p]
                    sources.append(s)
        ends = any(left[s] for s in sources)
        level = []
        for s in () if ends else sources:
            for q in users[s]:
                if q not in depth and moved[q][s]:
                    depth[q] = reached[s] + 1
                    level.append(q)
    if not ends:
        return 0
    # ways still to be tried, of a pattern to sources and of a source to patterns that gave to it
    onward = {p: [s for s in moved[p] if reached.get(s) == d] for p, d in depth.items()}
    back = {s: [q for q in users[s] if depth.get(q) == d + 1 and moved[q][s]] for s, d in reached.items()}
    total = 0
    for root in roots:
        path: list[tuple[int, int]] = []  # (pattern, the source it gives to)
        p = root
        while spare[root]:
            if not onward[p]:  # a dead end: go back, and never come here again
                if not path:
                    break
                before, s = path.pop()
                back[s].pop()
                p = before
                continue
            s = onward[p][-1]
            if left[s]:
                steps = [*path, (p, s)]
                n = min(spare[root], left[s], *(moved[q][t] for (_, t), (q, _) in zip(steps, steps[1:])))
                for i, (q, t) in enumerate(steps):
                    moved[q][t] += n
                    if i:
                        moved[q][steps[i - 1][1]] -= n
                spare[root] -= n
                left[s] -= n
                total += n
                path, p = [], root
            elif back[s] and moved[back[s][-1]][s]:
                path.append((p, s))
                p = back[s][-1]
            elif back[s]:
                back[s].pop()
            else:
                onward[p].pop()
    return total


def mix(docs: DataFrame, sources: Column | None = None, size: Column | None = None, doc_id: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each document, and the plan by source.

    ``sources`` is an array of names (default: the column ``source`` alone); null is a source of its
    own and the last, names are in code point order. ``size`` defaults to the words of ``text``.
    The first result has __doc (the input row as a struct), size, copies and parts (per source: how
    many copies, in source order); the second source, source_size, target. A document of size 0 is
    never taken, nor one without any source. Documents in the same hash place are ordered by id,
    size and content, so repeated rows are told apart only where it makes no difference. An empty
    table gives two empty ones.
    """
    spark = docs.sparkSession
    names = F.array("source") if sources is None else sources
    key = F.array_sort(F.array_distinct(F.transform(names, lambda s: F.concat(F.when(s.isNull(), "1").otherwise("0"), F.coalesce(s.cast("string"), F.lit(""))))))
    rows = stored(docs.select(
        F.struct("*").alias("__doc"), F.coalesce(key, F.array().cast("array<string>")).alias("pattern"),
        (n_words(F.col("text").cast("string")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("place")))

    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted((tuple(r["pattern"]), r["size"]) for r in totals)
    order = sorted({s for p, _ in patterns for s in p})
    at = {s: i for i, s in enumerate(order)}
    sizes = [sum(n for p, n in patterns if s in p) for s in order]
    by_weight = [weights[i % len(weights)] for i in range(len(order))]
    whole = sum(n for _, n in patterns)
    wanted = targets(sizes, by_weight, share * whole / sum(sizes) if sum(sizes) else share)
    routed = flow([(tuple(at[s] for s in p), n) for p, n in patterns], [round(t) for t in wanted])
    plan = []
    for (p, n), moved in zip(patterns, routed):
        ends = [sum(moved[at[s]] for s in p[:i + 1]) for i in range(len(p))]
        plan.append((list(p), n, [(s[1:] if s[0] == "0" else None, end) for s, end in zip(p, ends)]))
    routes = spark.createDataFrame(plan, "pattern array<string>, line long, routes array<struct<source:string,upto:long>>")
    by_source = spark.createDataFrame(
        [(s[1:] if s[0] == "0" else None, n, t) for s, n, t in zip(order, sizes, wanted)],
        "source string, source_size long, target double")

    # where a document starts on its pattern's line: sums of whole buckets, then inside its bucket
    buckets = max(1, sum(r["n"] for r in totals) // BUCKET)
    bucket = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).alias("bucket")
    rows = rows.select("*", bucket)
    # buckets are added up a thousand at a time, so that no window grows with the documents of a pattern
    wide = F.floor(F.col("bucket") / WIDE).alias("wide")
    fine = stored(rows.groupBy("pattern", "bucket", wide).agg(F.sum("size").alias("sum")))
    wider = fine.groupBy("pattern", "wide").agg(F.sum("sum").alias("sum"))
    ahead = lambda by, order: F.coalesce(F.sum("sum").over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wider = wider.select("pattern", "wide", ahead(["pattern"], "wide").alias("base"))
    sums = fine.withColumn("ahead", ahead(["pattern", "wide"], "bucket")).join(wider, ["pattern", "wide"]).select(
        "pattern", "bucket", (F.col("base") + F.col("ahead")).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("place", f"__doc.{doc_id}", "size", F.xxhash64("__doc")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["pattern", "bucket"]).join(F.broadcast(routes), "pattern")
    )
    # copy c of a document goes to the source in whose stretch of the line its middle lies
    middles = F.transform(F.sequence(F.lit(0), F.lit(len(COSTS) - 1)), lambda c: 2 * (c * F.col("line") + F.col("start") + F.col("base")) + F.col("size"))
    parts = F.transform("routes", lambda r, i: F.struct(r["source"].alias("source"), F.size(F.filter(
        middles, lambda m: (m < 2 * r["upto"]) & (m >= 2 * F.coalesce(F.get(F.col("routes"), i - 1)["upto"], F.lit(0))))).alias("copies")))
    parts = F.when(F.col("size") > 0, parts).otherwise(F.transform("routes", lambda r: F.struct(r["source"].alias("source"), F.lit(0).alias("copies"))))
    taken = placed.select("__doc", "size", parts.alias("parts"))
    copies = F.aggregate("parts", F.lit(0), lambda n, p: n + p["copies"])
    return taken.select("__doc", "size", copies.alias("copies"), "parts"), by_source


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed by the column ``source``: rows not taken go, rows taken twice come twice."""
    taken, _ = mix(docs)
    return taken.select("__doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).select("__doc.*")
