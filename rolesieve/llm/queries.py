"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm import mixing, packing, quality, repair, rollups, secrets, simhash, substrings, toolcalls, toxicity, trie, vectors, warc
from rolesieve.llm.common import shared_folder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tools of the conversations below and what their arguments must be.
TOOLS = {
    "search": {"type": "object", "required": ["text", "limit"], "properties": {"text": {"type": "string", "minLength": 20}, "limit": {"type": "integer", "maximum": 45}}},
    "fetch": {"type": "object", "required": ["text"], "properties": {"after": {"type": "string", "pattern": r"^\$ref:"}}},
    "store": {"type": "object", "required": ["text", "limit"], "properties": {"limit": {"type": "integer", "minimum": 3}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns: an assistant's turn calls a tool with its text and
    refers to the call before it, now and then to the one after it, rarely both ways; a user's turn
    is the result of the turn before it."""
    name = lambda turn: F.concat(F.col("conv_id"), F.lit("-"), turn)
    size = F.length("text")
    other = F.when(size % 5 == 0, F.col("turn") + 2).when(F.col("turn") >= 3, F.col("turn") - 2)
    arguments = F.to_json(F.struct("text", (size % 50).alias("limit"), F.concat(F.lit("$ref:"), name(other)).alias("after")))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("pos"), name(F.col("turn")).alias("call_id"),
        F.get(F.array(*map(F.lit, TOOLS)), size % 3).alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("pos"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    linked = toolcalls.rendered(toolcalls.link(calls, results, TOOLS))
    return linked.select("conv_id", "call_id", "call_pos", "result_pos", "name", "status", F.array_join("errors", "; ").alias("errors"),
                         F.col("position.at").alias("order_at"), F.col("position.step").alias("order_step"), "json")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    manifest = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("__doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = vectors.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("__row.vec_id", "n_links", "component_id", F.col("__row.vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those labelled toxic go; languages other than English are counted anew
    by the second tokenizer; the first batch is sent once more, to no effect; all is folded."""
    first, second = rollups.TOKENIZERS
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", *(rollups.tokens(F.col("text"), t).alias(t) for t in (first, second)))
    counted = stored(docs.drop("text")).withColumn("text", F.lit(None).cast("string"))
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    gone, kept = counted.join(toxic, "doc_id", "left_semi"), counted.join(toxic, "doc_id", "left_anti")
    load = rollups.change(counted, 1, first, F.col(first))
    foreign = kept.where("lang <> 'en'")
    rollup = rollups.Rollup(spark)
    rollup.commit("load", load)
    rollup.commit("toxic-out", rollups.change(gone, -1, first, F.col(first)))
    rollup.commit("recount", rollups.change(foreign, -1, first, F.col(first)).unionByName(rollups.change(foreign, 1, second, F.col(second))))
    rollup.commit("load", load)
    rollup.compact("through-recount")
    return rollup.totals()


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    taken, by_source = mixing.mix(docs, size=F.col("words"))
    rows = taken.select("__doc.doc_id", F.col("__doc.source").alias("source"), "size", (F.col("size") * F.col("copies")).alias("taken"))
    by_source = by_source.withColumnRenamed("source", "name")
    return rows.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = tuple(r.kind for r in secrets.RULES)
    rows = secrets.Scan(docs, F.col("text"), [F.col("doc_id")]).by_row()
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{kinds[k]}") for k in range(secrets.BASE)),
        F.sha2(secrets.listed(base, kinds), 256).alias("base_sha256"), secrets.listed(F.col("spans"), kinds).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=F.struct("doc_id"))
    return found.select("__doc.doc_id", simhash.fingerprint_hex(F.col("code")).alias("fingerprint"), "component_id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, place, token, chars) and ids (conv) of conversations that share beginnings: the
    first h turns of conversation c - c % 100, then c's own turns after its first h, h by c's CRC-32.
    Turns with equal numbers go by role, then digest."""
    token = trie.token(F.col("role"), F.col("text"))
    light = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), token.alias("token"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    own = stored(trie.placed(light, "conv", ["turn", "role", "token"]).select("conv", "place", "token", "chars"))
    ids = own.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string")) % 6)
    heads = own.where("place <= 5 and conv % 100 = 0").withColumnRenamed("conv", "base")
    taken = ids.withColumn("base", F.col("conv") - F.col("conv") % 100).join(heads, "base").where("place <= h").select("conv", "place", "token", "chars")
    before = taken.groupBy("conv").agg(F.count("*").alias("n"))
    rest = own.join(ids.join(before, "conv", "left"), "conv").where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.coalesce("n", F.lit(0))).alias("place"), "token", "chars")
    return stored(taken.unionByName(rest)), ids.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.of_tokens(*rebuilt(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return nodes.drop("key", "parent")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.Factors(docs, carry=F.struct("doc_id")).counts()
    return found.select("__doc.doc_id", "n_words", "n_removed", "kept_sha256")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.Repair(repair.damaged(turns)).reports()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    none = F.sha2(F.lit(""), 256)
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_warc, op3_quality_rules, op4_vector_graph, op5_token_rollup, op6_mixing, op7_secret_scan, op8_toxicity, op9_packing, op10_simhash,
    op11_prefix_trie, op12_substring_dedup, op13_structure_repair,
)}
