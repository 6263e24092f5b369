"""Scoring-run reports: AGG-5 to AGG-7, WIN-5, JOI-6, JOI-7, SRT-4, SNK-7."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.values import estimated_cost, round3, round_half_even
from rolesieve.session import checkpointed

# The nine per-run numbers a comparison takes the median of.
RUN_METRICS = (
    "seconds", "calls", "skipped", "rate_limit_hits", "wait_seconds",
    "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd",
)
# Size of the sketch that narrows a bracket, and the steps it is read at: a step is ten times its error.
_SKETCH_SIZE, _GRID = 10_000, 1_000
#: Rows between the ends of a bracket that are ordered in one place; a wider one is narrowed first.
SHORT = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their group in ``groups``; a null key is a key like others."""
    other = groups.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(other, same).drop(*(f"_key_{k}" for k in keys))


def token_sums(usage: DataFrame, *keys: str) -> DataFrame:
    """AGG-5: calls and tokens per run. With no key, one row, zeros when empty."""
    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0)).alias(c)

    return usage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), total("prompt_tokens"), total("completion_tokens"),
        total("total_tokens"))


def with_cost(sums: DataFrame, model: str = "model") -> DataFrame:
    """SC-21 on token sums."""
    return sums.withColumn("estimated_cost_usd", estimated_cost(model, "prompt_tokens", "completion_tokens"))


def medians(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], short: int = SHORT) -> DataFrame:
    """AGG-6: exact median of every metric per key, the mean of the middle two for an even count.

    No large group is brought together. A bracket around the middle starts at the least and the
    greatest value. While one may hold more than ``short`` rows between its ends, a sketch of fixed
    size of those rows alone cuts it to about half a hundredth. What lies below and at the ends is
    only counted, all metrics in one pass; the few rows between are put in order. Nulls do not
    count; a group without any value has null. One row per key and round is written to the
    checkpoint folder.
    """
    keys, metrics = list(keys), list(metrics)
    rows = rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    brackets = checkpointed(rows.groupBy(*keys).agg(*(F.expr(
        f"struct(min(`{m}`) AS low, max(`{m}`) AS high, count(`{m}`) AS n, count(`{m}`) AS most) AS `{m}`") for m in metrics)))
    while _widest(brackets, metrics) > short:
        steps = "array(" + ", ".join(f"{i / _GRID}D" for i in range(_GRID + 1)) + ")"
        counted = _counted(rows, brackets, keys, metrics, f"struct(count(inside) AS n, percentile_approx(inside, {steps}, {_SKETCH_SIZE}) AS grid)")
        brackets = checkpointed(_each(counted, keys, metrics, _narrowed, "{}"))
    ordered = _counted(rows, brackets, keys, metrics, "array_sort(collect_list(inside))")
    return _each(ordered, keys, metrics, _middle, "median_{}")


def _widest(brackets: DataFrame, metrics: Sequence[str]) -> int:
    most = brackets.agg(*(F.max(f"{m}.most") for m in metrics)).first()
    return max((n for n in most if n is not None), default=0)


def _counted(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], metrics: Sequence[str], inner: str) -> DataFrame:
    """Each metric's bracket with the rows below it, at its ends, and ``inner`` of those ``inside``."""
    near = join_groups(rows, brackets.withColumnsRenamed({m: f"_b_{m}" for m in metrics}), keys)

    def part(m: str) -> Column:
        v, low, high = f"`{m}`", f"`_b_{m}`.low", f"`_b_{m}`.high"
        between = inner.replace("inside", f"CASE WHEN {v} > {low} AND {v} < {high} THEN {v} END")
        return F.expr(f"""struct(any_value({low}) AS low, any_value({high}) AS high, any_value(`_b_{m}`.n) AS n,
            count_if({v} < {low}) AS below, count_if({v} = {low}) AS at_low,
            count_if({v} = {high} AND {low} < {high}) AS at_high, {between} AS inner) AS `{m}`""")

    return near.groupBy(*keys).agg(*map(part, metrics))


def _each(counted: DataFrame, keys: Sequence[str], metrics: Sequence[str], body: Callable[[Column], Column], name: str) -> DataFrame:
    """``body`` of every metric's struct; written as one lambda, so the plan does not grow with the metrics."""
    done = counted.select(*keys, F.transform(F.array(*metrics), body).alias("_m"))
    return done.select(*keys, *(F.get("_m", F.lit(i)).alias(name.format(m)) for i, m in enumerate(metrics)))


def _ranks(b: Column) -> tuple[Column, Column]:
    """Ranks of the two middle rows among those above the lower end."""
    return tuple(F.floor(r) - b["below"] - b["at_low"] for r in ((b["n"] + 1) / 2, b["n"] / 2 + 1))


def _narrowed(b: Column) -> Column:
    """The steps of the grid on either side of the middle; an end that holds the middle stays."""
    inner, (first, second) = b["inner"]["n"], _ranks(b)
    lower = F.greatest(F.floor(first * _GRID / inner) - 1, F.lit(0))
    upper = F.least(F.ceil(second * _GRID / inner) + 1, F.lit(_GRID))
    value = lambda step: F.get(b["inner"]["grid"], step.cast("int"))
    low = F.when(first <= 0, b["low"]).when(first <= inner, value(lower)).otherwise(b["high"])
    high = F.when(second <= 0, b["low"]).when(second <= inner, value(upper)).otherwise(b["high"])
    from_step, to_step = F.when(first <= 0, 0).otherwise(lower), F.when(second > inner, _GRID).otherwise(upper)
    most = F.when((inner == 0) | (second <= 0) | (first > inner), 0).otherwise(
        F.ceil(inner * ((to_step - from_step) / _GRID + 3 / _SKETCH_SIZE)) + 1)  # steps, and the error of both ends
    return F.struct(low.alias("low"), high.alias("high"), b["n"].alias("n"), most.alias("most"))


def _middle(b: Column) -> Column:
    # The sketch's error bound is a tenth of a step, so this cannot happen; it must not pass unseen.
    missed = F.raise_error(F.lit("the median lies outside its bracket")).cast("double")

    def value(rank: Column) -> Column:
        size = F.size(b["inner"])
        return F.when(rank + b["at_low"] <= 0, missed).when(rank <= 0, b["low"]) \
            .when(rank <= size, F.get(b["inner"], (rank - 1).cast("int"))) \
            .when(rank <= size + b["at_high"], b["high"]).otherwise(missed)

    first, second = _ranks(b)
    return F.when(b["n"] > 0, (value(first) + value(second)) / 2)


def runs_beside_median(runs: DataFrame, keys: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """AGG-7: every raw run time beside its group's median, one row per run.

    Rows instead of a list per group: a list would gather a whole group in one place.
    """
    return join_groups(runs, medians(runs, keys, [seconds]), keys)


def run_times_list(runs: DataFrame, keys: Sequence[str], limit: int = 1000) -> DataFrame:
    """AGG-7: raw run times of a group as one list in run order, for the small report document.

    A group with more runs than ``limit`` is an error, raised before anything is gathered;
    ``runs_beside_median`` has no such bound.
    """
    sizes = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    checked = join_groups(runs, sizes, keys).withColumn(
        "seconds", F.when(F.col("_n") <= limit, F.col("seconds")).otherwise(
            F.raise_error(F.lit("too many runs for one list; use runs_beside_median")).cast("double")))
    return checked.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("run_id", "seconds"))),
        lambda r: round3(r["seconds"])).alias("all_run_seconds"))


def worker_results(runs: DataFrame) -> DataFrame:
    """AGG-6 over the nine metrics per worker count, rounded as the report shows them."""
    counted = runs.groupBy("workers").agg(
        F.count(F.lit(1)).alias("runs"), F.max("jobs_matched").alias("jobs_matched"))
    middle = medians(runs, ["workers"], RUN_METRICS)
    return counted.join(middle, "workers").withColumns({
        "median_seconds": round3("median_seconds"),
        "median_wait_seconds": round3("median_wait_seconds"),
        "median_estimated_cost_usd": round_half_even("median_estimated_cost_usd", 6),
    })


def latest(results: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """WIN-5: the newest row per key. An aggregate, so each task passes on one row per key."""
    row = F.max_by(F.struct(*results.columns), F.struct(*order))
    return results.groupBy(key).agg(row.alias("_row")).select(
        *(F.col("_row")[c].alias(c) for c in results.columns))


def merge_results(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """WIN-5: results of earlier runs with later ones written over them."""
    return latest(old.unionByName(new), key, order)


def worker_table(results: DataFrame) -> DataFrame:
    """SNK-7: comparison table; matched is what was not skipped."""
    return results.select(
        F.col("workers").cast("int").alias("workers"),
        F.col("median_seconds").alias("match_s"),
        (F.col("jobs_matched") - F.col("median_skipped")).alias("matched"),
        F.col("median_skipped").alias("skipped"),
        F.col("median_rate_limit_hits").alias("rate_limit_hits"),
        F.col("median_wait_seconds").alias("wait_s"),
        F.col("median_total_tokens").alias("tokens"),
        F.col("median_estimated_cost_usd").alias("cost_usd"))


def by_worker_count(table: DataFrame) -> DataFrame:
    """SRT-4: numeric order of a worker count that may be stored as text."""
    return table.orderBy(F.col("workers").cast("int"))


def compare_runs(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """JOI-6: both scores of every row two runs share, and whether they differ."""
    a = first.select(key, F.col("score").alias("score_run1"))
    b = second.select(key, F.col("score").alias("score_run2"))
    return a.join(b, key).withColumn(
        "differs", ~F.col("score_run1").eqNullSafe(F.col("score_run2")))


def comparison_totals(compared: DataFrame) -> DataFrame:
    """JOI-6: how many rows both runs share and how many of them differ."""
    return compared.agg(F.count(F.lit(1)).alias("jobs_in_both"), F.count_if("differs").alias("scores_differing"))


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """JOI-7: the same totals for two filter settings, one row each. Input is usage per kept job."""
    def totals(df: DataFrame, phase: str) -> DataFrame:
        sums = token_sums(df).withColumn("model", F.lit(fixed.PRICED_MODEL))
        return with_cost(sums).select(F.lit(phase).alias("phase"), "calls", "prompt_tokens",
                                      "completion_tokens", "total_tokens", "estimated_cost_usd")

    return totals(before, "before").unionByName(totals(after, "after"))
