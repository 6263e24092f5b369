"""File sinks: SNK-1 to SNK-6.

Every sink writes a folder of part files that together, in name order, are the document. Whole
documents (a JSON array, a report) are built as ordered lines, so no row ever holds the document
and no task the whole of it. ``single_file`` puts it in one part, for a short top-k result.
``in_order`` says that the rows come in rank order already, as ``rank.rank_all`` gives them: each
partition then becomes a part as it is, header and footer parts of their own, and nothing is sorted.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import first_truthy, skills_text

_JSON = {"ignoreNullFields": "false"}
#: What comes before the rows of a document, the rows, what comes after.
_SECTIONS = (0, 1, 2)


def csv_rows(ranked: DataFrame) -> DataFrame:
    """SNK-1: the ten columns in their fixed order."""
    columns = {
        "rank": F.col("rank"), "score": F.col("score"), "title": F.col("job.title"),
        "company": F.col("job.company"), "location": F.coalesce("job.location", F.lit("")),
        "source": F.col("job.source"), "url": F.col("job.url"),
        "matched_skills": skills_text("matched_skills"),
        "missing_skills": skills_text("missing_skills"), "rationale": F.col("rationale"),
    }
    return ranked.select(*(columns[c].alias(c) for c in fixed.CSV_COLUMNS))


def csv_lines(ranked: DataFrame) -> DataFrame:
    """SNK-1 as ordered lines: a header, also with no rows, then one record per match.

    A value with a comma, quote or line break is quoted, its quotes doubled, and kept as it is;
    Spark's own writer would turn line breaks inside a value into the record separator.
    """
    rows = csv_rows(ranked)

    def cell(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)

    body = rows.select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("line"),
                       F.concat_ws(",", *map(cell, fixed.CSV_COLUMNS)).alias("value"))
    return _fixed_lines(ranked, (0, ",".join(fixed.CSV_COLUMNS))).unionByName(body)


def write_csv(ranked: DataFrame, path: str, single_file: bool = False, in_order: bool = False) -> None:
    """SNK-1: CRLF lines, the header in the first part only."""
    write_lines(csv_lines(ranked), path, single_file, "\r\n", in_order)


def json_rows(ranked: DataFrame) -> DataFrame:
    """SNK-2: full structure, the job nested."""
    return ranked.select("rank", "job", "score", "matched_skills", "missing_skills", "rationale")


def write_json_lines(ranked: DataFrame, path: str, in_order: bool = False) -> None:
    """SNK-2: one JSON object per line, nulls written out."""
    rows = json_rows(ranked)
    (rows if in_order else rows.orderBy("rank")).write.mode("overwrite").options(**_JSON).json(path)


def _line(order: int, section: int, text: Column) -> list[Column]:
    return [F.lit(section).alias("section"), F.lit(order).cast("long").alias("line"), text.alias("value")]


def _fixed_lines(ranked: DataFrame, *lines: tuple[int, str]) -> DataFrame:
    return ranked.sparkSession.createDataFrame(
        [(section, 0, text) for section, text in lines], "section int, line long, value string")


def json_array_lines(ranked: DataFrame) -> DataFrame:
    """SNK-2 as one array: an opening line, one line per row, a closing line."""
    rows = json_rows(ranked)
    text = F.to_json(F.struct(*rows.columns), _JSON)
    body = rows.select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("line"),
                       F.when(F.col("rank") == 1, text).otherwise(F.concat(F.lit(","), text)).alias("value"))
    return _fixed_lines(ranked, (0, "["), (2, "]")).unionByName(body)


def markdown_section() -> Column:
    """SNK-3: text of one ranked match."""
    def bold(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}:** "), value)

    # Labels and layout of the report.
    return F.concat_ws(
        "\n", F.lit(""),
        F.concat(F.lit("## "), F.col("rank"), F.lit(". "), F.col("job.title"), F.lit(" — "), F.col("job.company")),
        F.lit(""),
        bold("Score", F.concat(F.col("score").cast("string"), F.lit("/100"))),
        bold("Location", first_truthy("job.location", F.lit(fixed.NOT_SPECIFIED))),
        bold("Source", F.col("job.source")),
        bold("URL", F.col("job.url")),
        F.lit(""),
        bold("Matched Skills", skills_text("matched_skills")),
        bold("Missing Skills", skills_text("missing_skills")),
        F.lit(""),
        bold("Why it matches", F.col("rationale")))


def markdown_lines(ranked: DataFrame, title: str = "Job Matches") -> DataFrame:
    """SNK-3: a heading, one section per match, a fixed line when there is none."""
    body = ranked.select(F.lit(1).alias("section"), F.col("rank").cast("long").alias("line"),
                         markdown_section().alias("value"))
    none = ranked.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        *_line(0, 2, F.lit("\n" + fixed.NO_MATCHES_LINE)))
    return _fixed_lines(ranked, (0, f"# {title}")).unionByName(body).unionByName(none)


SKIP_FIELDS = ("id", "title", "company", "error_type", "error_message", "attempts")


def skip_report_lines(skips: DataFrame) -> DataFrame:
    """SNK-4 / AGG-8: count, then every skip in input order; both also when there is none."""
    head = skips.agg(F.count(F.lit(1)).alias("n")).select(*_line(0, 0, F.concat(
        F.lit('{"skipped_jobs": '), F.col("n"), F.lit(', "skipped_details": ['))))
    first = skips.agg(F.min("seq")).scalar()
    text = F.to_json(F.struct(*SKIP_FIELDS), _JSON)
    body = skips.select(F.lit(1).alias("section"), F.col("seq").alias("line"),
                        F.when(F.col("seq") == first, text).otherwise(F.concat(F.lit(","), text)).alias("value"))
    return head.unionByName(body).unionByName(_fixed_lines(skips, (2, "]}")))


def write_lines(lines: DataFrame, path: str, single_file: bool = False, separator: str = "\n",
                in_order: bool = False) -> None:
    """Ordered lines as text parts; the folder is made when missing (SNK-6).

    With ``in_order`` the lines of each section come in order already; the sections are put one
    after the other, which moves no row. One file is always sorted: merging partitions into one
    task may take them in any order.
    """
    if in_order and not single_file:
        ordered = reduce(DataFrame.unionByName, (lines.filter(F.col("section") == s) for s in _SECTIONS))
    else:
        ordered = lines.orderBy("section", "line")
    ordered = ordered.select("value")
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").text(
        path, lineSep=separator)


def write_json_array(ranked: DataFrame, path: str, single_file: bool = False, in_order: bool = False) -> None:
    write_lines(json_array_lines(ranked), path, single_file, in_order=in_order)


def write_markdown(ranked: DataFrame, path: str, title: str = "Job Matches", single_file: bool = False,
                   in_order: bool = False) -> None:
    write_lines(markdown_lines(ranked, title), path, single_file, in_order=in_order)


def write_skip_report(skips: DataFrame, path: str, single_file: bool = False) -> None:
    write_lines(skip_report_lines(skips), path, single_file)


def object_lines(fields: Sequence[DataFrame], head: Mapping[str, object]) -> DataFrame:
    """SNK-5: a JSON object as ordered lines: ``head``, then every table of one row and one column
    as a field of that name."""
    lines = [field.select(*_line(n, 1, F.concat(F.lit(", " if n or head else ""), _field(field.columns[0], F.col(field.columns[0])))))
             for n, field in enumerate(fields)]
    ends = _fixed_lines(fields[0], (0, "{" + json.dumps(dict(head))[1:-1]), (2, "}"))
    return reduce(DataFrame.unionByName, lines, ends)


def _field(name: str, value: Column) -> Column:
    """``"name": value``; the braces of an object with that one field are cut off."""
    text = F.to_json(F.struct(value.alias(name)), _JSON)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def worker_report_lines(results: DataFrame, head: Mapping[str, object]) -> DataFrame:
    """SNK-5: the report of a worker comparison as ordered lines of one JSON object, a line per
    worker count in numeric order."""
    workers = F.col("workers").cast("int")
    first = results.agg(F.min(workers)).scalar()
    entry = F.to_json(F.map_from_entries(F.array(F.struct(
        workers.cast("string"), F.struct(*(c for c in results.columns if c != "workers"))))), _JSON)
    body = results.select(F.lit(1).alias("section"), workers.cast("long").alias("line"), F.concat(
        F.when(workers == first, "").otherwise(", "), F.substring(entry, F.lit(2), F.length(entry) - 2)).alias("value"))
    start = "{" + "".join(f"{json.dumps(k)}: {json.dumps(x)}, " for k, x in head.items()) + '"by_workers": {'
    return _fixed_lines(results, (0, start), (2, "}}")).unionByName(body)
