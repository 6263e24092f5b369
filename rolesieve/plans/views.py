"""The shared test tables seen as postings, replies, runs and logs.

Each view is built in Spark and, under the same name, as SQL text for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.html import html_to_text
from rolesieve.functions.text import truthy
from rolesieve.profile import Profile

# A profile over the words of the part table: it makes every rule keep some rows and drop others.
PART_PROFILE = Profile(
    roles=("red widget", "Small Ring", "blue bolt promo"),
    locations=("Asia", "NATION 1", "Remote"),
    skills=("widget", "ring", "PROMO", "red", "large"),
    excluded_companies=(" brand#3", "BRAND#17 ", "Brand#99"),
    exclude_title_words=("economy", "old", "hot ring"),
    min_years=0, max_years=2,
    technical_words=("widget", "gizmo", "bolt", "plate"),
    management_words=("large", "small gizmo"),
    location_aliases={"asia": ("asia", "middle east")},
    home_country="europe",
)

WORD_PROFILE = Profile(skills=("the", "of", "de", "Und", "with", "para", "ther", "le"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part_columns(part_seq: Column) -> list[Column]:
    return [
        part_seq.alias("seq"), F.col("p_partkey").cast("string").alias("id"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"),
        F.col("p_brand").alias("company"), F.concat("n_name", F.lit(", "), "r_name").alias("location"),
        F.concat(F.lit("https://x.example/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"),
                 "p_name", F.lit("#"), "p_partkey").alias("url"),
        F.col("p_size").cast("double").alias("score"),
    ]


def parts_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JP: one posting per part. Nation and region are fixed lists of 25 and 5 rows."""
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    return part.join(nation, (part.p_partkey % 25) == nation.n_nationkey) \
        .join(region, nation.n_regionkey == region.r_regionkey).select(*_part_columns(F.col("p_partkey")))


JP_SQL = """
jp AS (
  SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || lower(p_type) AS title,
         p_brand AS company, n_name || ', ' || r_name AS location,
         'https://x.example/' || replace(p_brand, '#', '-') || '/' || p_name || '#' || p_partkey AS url,
         CAST(p_size AS DOUBLE) AS score
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def lines_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JL: one posting per order line, so some keys come up very often."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    return lines.join(part, lines.l_partkey == part.p_partkey) \
        .join(nation, (F.col("l_orderkey") % 25) == nation.n_nationkey) \
        .join(region, nation.n_regionkey == region.r_regionkey) \
        .select(*_part_columns(F.col("l_orderkey") * 8 + F.col("l_linenumber")))


JL_SQL = """
jl AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq, CAST(p_partkey AS VARCHAR) AS id,
         p_name || ' ' || lower(p_type) AS title, p_brand AS company, n_name || ', ' || r_name AS location,
         'https://x.example/' || replace(p_brand, '#', '-') || '/' || p_name || '#' || p_partkey AS url,
         CAST(p_size AS DOUBLE) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN nation ON l_orderkey % 25 = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def pages_as_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG without text: page as posting, host as company, page language as location."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), F.col("page_id").cast("string").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("company"),
        truthy(F.regexp_extract("html", '<html lang="([^"]*)"', 1)).alias("location"), "url", "html")


PG_SQL = """
pg AS (
  SELECT page_id AS seq, CAST(page_id AS VARCHAR) AS id,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(url, '^https?://([^/]+)/', 1) AS company,
         nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS location, url, html
  FROM pages)"""


def with_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("description", html_to_text("html"))


# The same tokens as the library finds in these pages, entities decoded with the ampersand last.
PT_SQL = PG_SQL + r""",
pieces AS (
  SELECT seq, list_transform(
    regexp_extract_all(html,
      '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[!?/]?[a-z][^>]*>|[^<]+|<'),
    lambda t: CASE
      WHEN regexp_matches(t, '(?is)^<(script|style)\b')
        THEN regexp_replace(t, '(?is)^<[^>]*>|</(script|style)\s*>$', '', 'g')
      WHEN regexp_matches(t, '(?is)^<[a-z!?/]') THEN ''
      ELSE regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'),
           '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') END) AS p
  FROM pg),
pt AS (
  SELECT pg.*, nullif(trim(regexp_replace(regexp_replace(array_to_string(p, ' '),
         '\s+([.,!?;:])', '\1', 'g'), '\s+', ' ', 'g')), '') AS description
  FROM pg JOIN pieces USING (seq))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV: every user turn as a request with the reply that follows it, or none.

    Turn ``n`` is answered by turn ``n + 1`` of the same conversation when the assistant speaks
    there. An equi-join, so a long conversation is not gathered in one place.
    """
    t = table(spark, sf_dir, "conversations")
    asked = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("request"))
    said = t.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(said, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "request", "reply")


CV_SQL = """
cv AS (
  SELECT a.conv_id * 1000 + a.turn AS seq, a.text AS request, b.text AS reply
  FROM (SELECT * FROM conversations WHERE role = 'user') a
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') b
    ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def events_as_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: events as a log of calls. Two event kinds fail, and waits come as header or as text."""
    e = table(spark, sf_dir, "events")
    seconds = F.format_string("%.2f", F.col("value"))
    kind = F.col("event_type")
    by_header = (F.col("event_id") % 3) == 0
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "RateLimitError").when(kind == "signup", "APITimeoutError")
        .when((kind == "view") & (F.col("value") > 100), "BadRequestError").alias("error_type"),
        F.when((kind == "error") & ((F.col("event_id") % 3) == 1),
               F.concat(F.lit("Limit reached. Please try again in "), seconds,
                        F.when((F.col("event_id") % 2) == 0, "ms.").otherwise("s."))).alias("message"),
        F.when((kind == "error") & by_header, seconds).alias("retry_after"),
        F.get_json_object("props", "$.k").cast("int").alias("workers"), "value")


EV_SQL = """
ev AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS job_id, CAST(ts AS TIMESTAMP) AS ts,
         CASE WHEN event_type = 'error' THEN 'RateLimitError' WHEN event_type = 'signup' THEN 'APITimeoutError'
              WHEN event_type = 'view' AND value > 100 THEN 'BadRequestError' END AS error_type,
         CASE WHEN event_type = 'error' AND event_id % 3 = 1
              THEN 'Limit reached. Please try again in ' || printf('%.2f', value)
                   || CASE WHEN event_id % 2 = 0 THEN 'ms.' ELSE 's.' END END AS message,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN printf('%.2f', value) END AS retry_after,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS workers, value
  FROM events)"""


def events_as_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV as scoring runs: one run per event, keyed by worker count."""
    v, n = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("run_id"), F.get_json_object("props", "$.k").cast("int").alias("workers"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("run_us"),
        F.round(v, 3).alias("seconds"), (n % 7).alias("calls"), (n % 3).alias("skipped"),
        (n % 5).alias("rate_limit_hits"), ((n % 1000) / 100).alias("wait_seconds"),
        (n % 1000 + 500).alias("prompt_tokens"), (n % 100 + 50).alias("completion_tokens"),
        (n % 1000 + n % 100 + 550).alias("total_tokens"),
        F.round(v / 1000, 6).alias("estimated_cost_usd"), F.lit(60).alias("jobs_matched"),
        F.col("event_type").alias("model"))


RN_SQL = """
rn AS (
  SELECT event_id AS run_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS workers,
         epoch_us(CAST(ts AS TIMESTAMP)) AS run_us, round(value, 3) AS seconds, event_id % 7 AS calls,
         event_id % 3 AS skipped, event_id % 5 AS rate_limit_hits, (event_id % 1000) / 100 AS wait_seconds,
         event_id % 1000 + 500 AS prompt_tokens, event_id % 100 + 50 AS completion_tokens,
         event_id % 1000 + event_id % 100 + 550 AS total_tokens,
         round(value / 1000, 6) AS estimated_cost_usd, 60 AS jobs_matched, event_type AS model
  FROM events)"""


def documents_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DL: documents as postings, their text as description."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("source").alias("company"),
        F.col("lang").alias("location"), F.col("text").alias("description"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"), F.lit("documents").alias("source"),
        F.lit(None).cast("date").alias("posted_date"))


def with_sql(*views: str, select: str) -> str:
    return "WITH " + ",".join(views).strip() + "\n" + select.strip()
