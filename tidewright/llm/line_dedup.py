"""Operator 7: line dedup by site-relative frequency. DataFrame functions only.

A site (host) is the document's source. A page is a different text of a host: copies of one text
count as one page, so that copying alone makes no line boilerplate. For each host and line, the
pages that contain the line are divided by the host's pages; lines on at least MIN_PAGES pages and
on more than MAX_RATIO of them are boilerplate and are dropped from every document of that host.
Lines are compared without the spaces around them; blank lines are never dropped.

Counting moves 16 bytes a line and page (digests), partly summed before the shuffle, never texts.
The boilerplate found is one row a host: at most (lines a page) / MAX_RATIO digests. It meets the
documents by host; small tables are broadcast, large ones joined with hot hosts split.

Defined results: null texts stay null and count as no page; a null host is a host of its own; a text
whose every line is dropped becomes empty; rows and all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, table, written

MAX_RATIO = 0.03
MIN_PAGES = 5


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, digests): the boilerplate lines of every host that has any."""
    own = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    pages = docs.select(col(host).cast("string").alias("host"), col(text).cast("string").alias("text")).where("text is not null")
    pages = pages.select("host", F.unhex(F.md5(F.col("text").cast("binary"))).alias("page"), F.array_distinct(F.transform(own, _digest)).alias("digests"))
    # of equal pages the lines are equal: any one of them
    pages = pages.groupBy("host", "page").agg(F.first("digests").alias("digests"))
    # one row a line, and one of no line for the host's total
    each = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("binary")), "digests")).alias("digest"))
    counts = written(each.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("digest").isNull() | (F.col("n") >= min_pages)), "line-counts")
    totals = counts.where("digest is null").select(F.col("host").alias("total_host"), F.col("n").alias("total"))
    often = counts.where("digest is not null").join(totals, F.col("host").eqNullSafe(F.col("total_host")))
    return often.where(F.col("n") > max_ratio * F.col("total")).groupBy("host").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """docs with the boilerplate lines taken out of its texts; `dropped` names a column for their number, if wanted."""
    at, by = free_name(docs, "digests"), free_name(docs, "host_")
    found = written(boilerplate(docs, host, text, max_ratio, min_pages).select(F.col("host").alias(by), F.col("digests").alias(at)), "boilerplate")
    joined = docs.join(found, col(host).cast("string").eqNullSafe(F.col(by)), "left")
    own = _lines(col(text).cast("string"))
    left = F.filter(own, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(at), _digest(x)))
    out = joined.withColumn(free_name(docs, "left_"), F.when(F.col(at).isNotNull(), left))
    kept = F.col(free_name(docs, "left_"))
    columns = [F.when(kept.isNull(), col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else col(c) for c in docs.columns]
    if dropped:
        columns.append(F.when(kept.isNull(), F.lit(0)).otherwise(F.size(own) - F.size(kept)).cast("long").alias(dropped))
    return out.select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, dropped="n_dropped").select("doc_id", "text", "n_dropped", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
page AS (SELECT DISTINCT source, text FROM doc WHERE text IS NOT NULL),
line AS (
  SELECT DISTINCT source, text, line FROM (SELECT source, text, trim(unnest(string_split(text, chr(10)))) AS line FROM page) WHERE line <> ''),
total AS (SELECT source, count(*) AS total FROM page GROUP BY source),
bad AS (
  SELECT source, line FROM (SELECT source AS s, line, count(*) AS n FROM line GROUP BY ALL)
  JOIN total ON total.source IS NOT DISTINCT FROM s WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * total),
each AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc WHERE text IS NOT NULL),
kept AS (
  SELECT each.r, string_agg(each.line, chr(10) ORDER BY i) FILTER (WHERE bad.line IS NULL) AS text, count(bad.line) AS n_dropped
  FROM each LEFT JOIN bad ON trim(each.line) = bad.line AND each.source IS NOT DISTINCT FROM bad.source GROUP BY each.r)
SELECT doc_id, CASE WHEN doc.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  length(CASE WHEN doc.text IS NOT NULL THEN coalesce(kept.text, '') END)::BIGINT AS n_chars
FROM doc LEFT JOIN kept USING (r)""",
}
