"""Table schemas. ``seq`` is the input position; Spark rows have no order of their own."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOB_FIELDS = ("id", "title", "company", "location", "description", "url", "source", "posted_date")

_JOB = [
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("location", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("posted_date", T.DateType(), True),
]
JOB_SCHEMA = T.StructType([T.StructField("seq", T.LongType(), False), *_JOB])

MATCH_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("job", T.StructType(_JOB), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("matched_skills", T.ArrayType(T.StringType()), False),
    T.StructField("missing_skills", T.ArrayType(T.StringType()), False),
    T.StructField("rationale", T.StringType(), False),
])

# What a scorer returns for one request: a reply, a refusal or an error.
REPLY_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("reply_json", T.StringType(), True),
    T.StructField("refusal", T.StringType(), True),
    T.StructField("error_type", T.StringType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("prompt_tokens", T.LongType(), True),
    T.StructField("completion_tokens", T.LongType(), True),
])

SKIP_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("error_type", T.StringType(), False),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), False),
])

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("error_type", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("retry_after", T.StringType(), True),
])

# seq = source (3 bits) | board ordinal (24 bits) | position in the payload (36 bits).
_POS_BITS, _BOARD_BITS = 36, 24


def make_seq(source_ord: int, board_ord, pos) -> Column:
    """Input position as one sortable long: source order, then board order, then array position."""
    board, p = _col(board_ord).cast("long"), _col(pos).cast("long")
    fits = (board < (1 << _BOARD_BITS)) & (p < (1 << _POS_BITS))
    packed = F.lit(source_ord << (_POS_BITS + _BOARD_BITS)).cast("long") \
        + F.shiftleft(board, _POS_BITS) + p
    return F.when(fits, packed).otherwise(
        F.raise_error(F.lit("board ordinal or record position is too large for seq")).cast("long"))


def job_struct() -> Column:
    return F.struct(*JOB_FIELDS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
