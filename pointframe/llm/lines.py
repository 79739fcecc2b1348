"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line is boilerplate on a host if it stands on at least MIN_PAGES of its pages and on more
than MAX_RATIO of them; its occurrences are dropped from every page of the host. What repeats over documents of many hosts
but stays at or below the ratio on each stays in place, so the same line may go from one host and stay on another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.llm.common import cut, free_name, read_documents

MAX_RATIO = 0.02
MIN_PAGES = 3
BROADCAST_LINES = 1_000_000  # boilerplate lines (two hashes each) up to which their sets are broadcast
SALT = 64  # parts that a host's pages are dealt into beyond that


def line_keys(text):
    """The lines of a text as keys of two hashes."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = False) -> DataFrame:
    """(host, lines): for each host with boilerplate, the keys of its lines.

    Pages of a host with the same text count once, so that a group of copies doesn't turn its text into boilerplate;
    with copies, each row counts. A host whose pages have D distinct lines on average has fewer than D / max_ratio of
    them, however many pages there are. Copies are dropped and counts summed before they are shuffled, so neither a hot
    host nor a hot page or line meets in one task.
    """
    text = F.col(text_col)
    page = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))
    blank = F.struct(F.xxhash64(F.lit("")).alias("a"), F.hash(F.lit("")).alias("b"))
    keys = F.array_remove(F.array_distinct(line_keys(text)), blank)
    pages = docs.filter(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), page.alias("page"), keys.alias("lines"))
    hosts = pages.select("host", "page")
    if not copies:
        pages, hosts = pages.dropDuplicates(["host", "page"]), hosts.distinct()
    per_line = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    per_host = hosts.groupBy("host").agg(F.count("*").alias("pages"))
    return per_line.join(per_host, "host").filter(F.col("n") > F.lit(max_ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = False, keep_whole: bool = False) -> DataFrame:
    """docs without the boilerplate lines of their hosts, with n_dropped, the number of lines dropped from each page.

    A page of nothing but boilerplate and blank lines loses its boilerplate as any other, or stays whole with keep_whole. A
    null host has no statistics and its pages stay as they are; null and empty texts stay; blank lines are never
    boilerplate; pages of a host with the same text count once, or each with copies; an empty table stays empty. A column n_dropped of docs is
    replaced; others stay.
    """
    known = cut(boilerplate(docs, host_col, text_col, max_ratio, min_pages, copies))
    size = known.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_dropped"])
    host, drop, salt, part = (free_name(docs, x) for x in ("_host", "_lines", "_salt", "_part"))
    if size["n"] + size["hosts"] <= BROADCAST_LINES:
        right = F.broadcast(known.select(F.col("host").alias(host), F.col("lines").alias(drop)))
        joined = docs.join(right, docs[host_col] == right[host], "left").drop(host)
    else:
        right = known.select(F.col("host").alias(host), F.col("lines").alias(drop), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(part))
        left = docs.withColumn(salt, F.pmod(F.xxhash64(text_col, host_col), F.lit(SALT)).cast("int"))
        joined = left.join(right, (left[host_col] == right[host]) & (left[salt] == right[part]), "left").drop(host, salt, part)
    return without_lines(joined, text_col, drop, keep_whole)


def without_lines(joined: DataFrame, text_col: str, drop: str, keep_whole: bool = False) -> DataFrame:
    """joined without the lines in its column drop, and without that column, with n_dropped."""
    text, left = F.col(text_col), free_name(joined, "_kept")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(drop), F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))))
    touched = joined.withColumn(left, F.when(F.col(drop).isNotNull() & text.isNotNull(), kept))
    cleaned = F.col(left).isNotNull()
    if keep_whole:
        cleaned &= F.exists(left, lambda x: x != "")
    return touched.select(
        *(F.when(cleaned, F.array_join(left, "\n")).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in joined.columns if c != drop),
        F.coalesce(F.when(cleaned, F.size(lines) - F.size(left)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that remains and the number of lines dropped; as in the SQL, each row is a page."""
    return drop_boilerplate(read_documents(spark, sf_dir).select("doc_id", "source", "text"), copies=True)


OP6_SQL = f"""
WITH hosts AS (
  SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source
), per_page AS (
  SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
), frequent AS (
  SELECT source, line, count(*) AS n FROM per_page WHERE line <> '' GROUP BY source, line HAVING count(*) >= {MIN_PAGES}
), boilerplate AS (
  SELECT source, list(line) AS dropped FROM frequent JOIN hosts USING (source) WHERE n > {MAX_RATIO} * pages GROUP BY source
), split AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS lines, dropped
  FROM documents d LEFT JOIN boilerplate b ON d.source = b.source
), kept AS (
  SELECT *, CASE WHEN dropped IS NOT NULL THEN list_filter(lines, lambda x: NOT list_contains(dropped, x)) END AS kept FROM split
), judged AS (
  SELECT *, kept IS NOT NULL AS cleaned FROM kept
)
SELECT doc_id, source,
       CASE WHEN cleaned THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CASE WHEN cleaned THEN len(lines) - len(kept) ELSE 0 END AS n_dropped
FROM judged
"""
