"""Tool-call linking: calls and results are joined by identifier, put into an order in which every
call stands behind those it refers to, checked against schemas, and written as canonical JSON.

Joins are on (conversation, identifier) hashes, so a long conversation spreads over tasks by its
identifiers and is never gathered for them. Order comes from labels: a call's label is its own
place, or, if it must wait for a later call, that call's place and one step more. Conversations of up
to LOCAL references, many to a task, get their labels in one walk; those beyond it get the same
labels in rounds of joins, in which only calls whose label still rises take part.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolesieve.llm.common import n_partitions, stored

#: A reference inside arguments to the result of another call of the same conversation.
REFERENCE = r'"\$ref:([^"]+)"'
#: References of a conversation that one task walks through.
LOCAL = 20_000
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a JSON value breaks of a schema with type, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength and pattern."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(type(value) is type(e) and value == e for e in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        for name in sorted(value):
            if name in known:
                out += problems(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{name}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]")]
    if _is(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)) if k in schema and bad(schema[k])]
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    return out


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def canonical(value) -> str:
    """JSON with sorted keys, no white space, no escapes but those needed; integral floats as integers."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def check(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """Canonical arguments and what is wrong with them; null arguments are an empty object."""
    try:
        value = json.loads(arguments if arguments is not None else "{}", parse_constant=_no_constant)
        text = canonical(value)
    except (ValueError, OverflowError, RecursionError):
        return None, ["$: invalid JSON"]
    if name not in schemas:
        return text, ["unknown tool"]
    return text, problems(value, schemas[name])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and one per result without a call.

    ``calls`` has conv_id, pos, call_id, name, arguments; ``results`` has conv_id, pos, call_id,
    content. The outcome has conv_id, call_id, call_pos, result_pos, name, arguments (canonical,
    null if invalid JSON), errors, content, status and position (place in its conversation's order).
    status: ok, invalid (arguments), missing_reference (to no call of the conversation), cycle,
    no_result, duplicate (a later call of an identifier already used), orphan_result,
    repeated_result (a later result of a call that has one). Calls in or behind a cycle, duplicates
    and results without a call have no position. Null identifiers link with nothing; null
    conversations are one of their own; ties of pos are broken by content. Empty tables give no rows.
    """
    @F.pandas_udf("text string, errors array<string>")
    def checked(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(n, a, schemas) for n, a in zip(names, arguments)], columns=["text", "errors"])

    text = lambda c: F.col(c).cast("string").alias(c)
    rows = calls.select("conv_id", F.col("pos").cast("long").alias("call_pos"), text("call_id"), text("name"), F.col("arguments").cast("string").alias("raw"))
    rows = rows.withColumn("c", checked("name", "raw"))
    rows = rows.select("conv_id", "call_pos", "call_id", "name", F.col("c.text").alias("arguments"), F.col("c.errors").alias("errors"),
                       F.array_distinct(F.regexp_extract_all(F.col("c.text"), F.lit(REFERENCE), F.lit(1))).alias("refs"))
    # the first call of an identifier owns it, the first result answers it: minima, joined by key
    rows = stored(rows.withColumn("row", F.struct("call_pos", "name", "arguments", F.monotonically_increasing_id().alias("n"))))
    key = ["conv_id", "call_id"]
    named = rows.where("call_id is not null")
    owners = named.groupBy(*key).agg(F.min("row").alias("first"))
    found = stored(results.select("conv_id", F.col("pos").cast("long").alias("result_pos"), text("call_id"), text("content"))
                   .withColumn("row", F.struct("result_pos", "content", F.monotonically_increasing_id().alias("n"))))
    answers = found.where("call_id is not null").groupBy(*key).agg(F.min("row").alias("answer"))

    rows = _join(rows, owners, key).withColumn("duplicate", F.col("call_id").isNotNull() & ~F.col("row").eqNullSafe(F.col("first")))
    first = stored(rows.where("call_id is not null and not duplicate").select("conv_id", "call_id", "call_pos", F.explode_outer("refs").alias("ref")))
    labels = _labels(first)
    rows = _join(_join(rows, answers, key), labels, key)
    status = (
        F.when(F.col("duplicate"), "duplicate").when(F.size("errors") > 0, "invalid").when(F.col("missing"), "missing_reference")
        .when(F.col("cyclic"), "cycle").when(F.col("answer").isNull(), "no_result").otherwise("ok"))
    ordered = F.when(~F.col("duplicate") & ~F.coalesce("cyclic", F.lit(False)), F.struct(
        F.coalesce("at", "call_pos").alias("at"), F.coalesce("step", F.lit(0)).alias("step"), "call_pos", "call_id", F.col("row.n").alias("n")))
    linked = rows.select(
        "conv_id", "call_id", "call_pos", F.when(~F.col("duplicate"), F.col("answer.result_pos")).alias("result_pos"), "name", "arguments", "errors",
        F.when(~F.col("duplicate"), F.col("answer.content")).alias("content"), status.alias("status"), ordered.alias("position"))
    loose = _join(_join(found, owners, key), answers, key).where(~(F.col("first").isNotNull() & F.col("row").eqNullSafe(F.col("answer"))))
    none = lambda kind: F.lit(None).cast(kind)
    return linked.unionByName(loose.select(
        "conv_id", "call_id", none("long").alias("call_pos"), "result_pos", none("string").alias("name"), none("string").alias("arguments"),
        none("array<string>").alias("errors"), "content", F.when(F.col("first").isNull(), "orphan_result").otherwise("repeated_result").alias("status"),
        none(linked.schema["position"].dataType).alias("position")))


def _join(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Left join in which a null conversation equals itself."""
    b = b.select(*(F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in b.columns))
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left").drop(*(f"__{c}" for c in key))


def _labels(first: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, call_id, at, step, missing, cyclic of each call; ``first`` has a row per reference.

    Sorting by (at, step) puts a call behind all it refers to.
    """
    sizes = first.groupBy("conv_id").agg(F.count("*").alias("n"))
    sized = _join(first, sizes, ["conv_id"])
    small, large = sized.where(f"n <= {local}").drop("n"), stored(sized.where(f"n > {local}").drop("n"))
    spark = first.sparkSession
    groups = n_partitions(spark, first.count(), 50_000)
    kind = first.schema["conv_id"].dataType.simpleString()
    walked = small.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(groups))).repartition(groups, "part").groupBy("part").applyInArrow(
        _walk, f"conv_id {kind}, call_id string, at long, step int, missing boolean, cyclic boolean")
    return walked if large.isEmpty() else walked.unionByName(_rounds(large))


def _walk(table: pa.Table) -> pa.Table:
    """Labels of whole conversations; what a walk from free calls does not reach is in or behind a cycle."""
    talks: dict = {}
    for conv, call, pos, ref in zip(*(table[c].to_pylist() for c in ("conv_id", "call_id", "call_pos", "ref"))):
        refs = talks.setdefault(conv, {}).setdefault(call, (pos, []))[1]
        if ref is not None:
            refs.append(ref)
    out = []
    for conv, calls in talks.items():
        label = {c: (pos, 0) for c, (pos, _) in calls.items()}
        waits, users = {}, {}
        for call, (_, refs) in calls.items():
            waits[call] = sum(r in calls for r in refs)
            for r in refs:
                users.setdefault(r, []).append(call)
        free = [c for c, n in waits.items() if not n]
        for call in free:
            at, step = label[call]
            for user in users.get(call, ()):
                label[user] = max(label[user], (at, step + 1))
                waits[user] -= 1
                if not waits[user]:
                    free.append(user)
        out += [(conv, c, *label[c], any(r not in calls for r in refs), waits[c] > 0) for c, (_, refs) in calls.items()]
    columns = list(zip(*out)) or [()] * 6
    kinds = (table.schema.field("conv_id").type, pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "call_id", "at", "step", "missing", "cyclic"])


def _rounds(first: DataFrame) -> DataFrame:
    """The labels of ``_walk`` by joins. A label can rise once for each other call of its
    conversation; one that rises more often, or whose own unshared place comes back to it, belongs
    to a call in a cycle, and what waits for such a call is behind it."""
    key = ["conv_id", "call_id"]
    nodes = first.groupBy(*key).agg(F.min("call_pos").alias("call_pos"))
    sizes = nodes.groupBy("conv_id").agg(F.count("*").alias("calls"))
    single = nodes.groupBy("conv_id", "call_pos").agg((F.count("*") == 1).alias("single"))
    target = nodes.select("conv_id", F.col("call_id").alias("ref"), F.col("call_pos").alias("ref_pos"), F.lit(True).alias("there"))
    references = stored(_join(first.where("ref is not null"), target, ["conv_id", "ref"]))
    missing = references.where("there is null").select(*key, F.lit(True).alias("missing")).distinct()
    edges = references.where("there").select("conv_id", "call_id", F.col("ref").alias("__r"))
    state = _join(_join(nodes, sizes, ["conv_id"]), single, ["conv_id", "call_pos"])
    state = stored(state.select(*key, "call_pos", "calls", "single", F.struct(F.col("call_pos").alias("at"), F.lit(0).alias("step")).alias("label"), F.lit(False).alias("cyclic"), F.lit(True).alias("rose")))
    while not state.where("rose").isEmpty():
        risen = state.where("rose").select(F.col("conv_id").alias("__c"), F.col("call_id").alias("ref"), F.col("label").alias("from"), F.col("cyclic").alias("behind"))
        offers = edges.join(risen, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("ref") == F.col("__r")))
        offers = offers.groupBy(*key).agg(F.max(F.struct(F.col("from.at").alias("at"), (F.col("from.step") + 1).alias("step"))).alias("offer"), F.max("behind").alias("behind"))
        both = _join(state, offers, key)
        higher = F.coalesce(F.col("offer") > F.col("label"), F.lit(False)) & ~F.col("cyclic")
        around = (F.col("single") & (F.col("offer.at") == F.col("call_pos"))) | (F.col("offer.step") >= F.col("calls"))
        cyclic = F.col("cyclic") | F.coalesce("behind", F.lit(False)) | (higher & F.coalesce(around, F.lit(False)))
        state = stored(both.select(*key, "call_pos", "calls", "single", F.when(higher, F.col("offer")).otherwise(F.col("label")).alias("label"),
                                   cyclic.alias("cyclic"), ((higher & ~cyclic) | (cyclic != F.col("cyclic"))).alias("rose")))
    return _join(state, missing, key).select(*key, "label.at", "label.step", F.coalesce("missing", F.lit(False)).alias("missing"), "cyclic")


def rendered(linked: DataFrame) -> DataFrame:
    """``linked`` with ``json``: the call and its result as one canonical line, for chat formatting."""
    @F.pandas_udf(StringType())
    def line(call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series, status: pd.Series) -> pd.Series:
        return pd.Series([canonical({"id": i, "name": n, "arguments": json.loads(a) if a is not None else None, "result": c, "status": s})
                          for i, n, a, c, s in zip(call_id, name, arguments, content, status)])

    return linked.withColumn("json", line("call_id", "name", "arguments", "content", "status"))
