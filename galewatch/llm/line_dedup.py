"""Line dedup by site-relative frequency.

A line is named by two 64-bit hashes of its trimmed text. Pages of a host that contain it, divided by the host's pages,
give its boilerplate ratio; lines above the limit go from every page of that host. A line must be on MIN_ON pages, as one page
repeats nothing; hosts of every size are treated alike.

A host's dropped lines number at most its lines per page divided by the ratio, whatever its number of pages. They are
written first, so that Spark broadcasts them only where their size is under its threshold and else splits hot hosts.

Defined cases: null text is kept as null with 0 lines; blank lines are never dropped and don't count; a null host is a
host of its own; repeated rows are pages of their own; an empty table gives an empty result;
other columns stay, but those named _n_lines and _n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.llm.common import stored, table

RATIO, MIN_ON = 0.2, 2
#: Columns that drop_lines adds.
ADDED = ("_n_lines", "_n_dropped")
BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def name_of(line: Column) -> Column:
    """The name of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """host (not null), text -> host, dropped: array of line names."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    # Distinct as strings, by hash: structs would be compared in pairs.
    lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n", -1), trimmed)), lambda x: x != "")
    found = pages.where(F.col("text").isNotNull()).select("host", F.explode(lines).alias("line")).select("host", name_of(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("on"))
    found = found.where(F.col("on") >= MIN_ON)
    return found.join(totals, "host").where(F.col("on") > F.col("pages") * ratio).groupBy("host").agg(F.collect_list("line").alias("dropped"))


def drop_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, keep_whole: bool = False) -> DataFrame:
    """All columns of pages, `text` without boilerplate lines, and _n_lines, _n_dropped.

    keep_whole: a page of nothing but boilerplate lines keeps them all.
    """
    named = pages.select(F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), F.col(text).alias("text"))
    lost = stored(boilerplate(named, ratio), "boilerplate").withColumnRenamed("host", "_host")
    # The page's own columns travel in one struct, so that none of them can clash with these.
    rows = pages.select(F.struct(*pages.columns).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_key")).join(lost, F.col("_key") == F.col("_host"), "left")
    lines = F.split("_text", "\n", -1)
    keep = F.filter("_lines", lambda x: (trimmed(x) == "") | ~F.array_contains(F.col("dropped"), name_of(trimmed(x))))
    rows = rows.withColumn("_lines", lines)
    rows = rows.withColumn("_kept", F.when(F.col("dropped").isNull(), F.col("_lines")).otherwise(keep))
    if keep_whole:
        rows = rows.withColumn("_kept", F.when(F.exists("_kept", lambda x: trimmed(x) != ""), F.col("_kept")).otherwise(F.col("_lines")))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    own = [F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row")[c].alias(c) for c in pages.columns if c not in ADDED]
    return rows.select(*own, n("_lines").alias("_n_lines"), (n("_lines") - n("_kept")).alias("_n_dropped"))


#: Read alike by Java's and RE2's engines. Blocks end lines; what is no text goes first. What is opened and never closed
#: runs to the end of the page, and a tag ends before the next one begins: so no pattern reads a page again from every
#: opener, and time is in proportion to a page's length.
NO_TEXT = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<head\b.*?(?:</head>|\z)|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|nav|section|header|footer|body|html|main|aside|blockquote|pre)\b[^<>]*>"
TAG = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def page_lines(html: Column) -> Column:
    """Text of a page, one line per block; entities stay as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, ""), BLOCK, "\n"), TAG, "")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), page_lines(F.col("html")).alias("text"))
    pages = stored(pages, "page_lines")  # both passes read the lines; taking them out of the HTML costs most
    return drop_lines(pages, "host", "text").select("page_id", "host", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


ORACLE = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{NO_TEXT}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS text,
         row_number() OVER () AS rid FROM pages),
l AS (SELECT rid, page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
d AS (SELECT b.host, b.t FROM b JOIN n ON b.host IS NOT DISTINCT FROM n.host WHERE t <> ''
      GROUP BY b.host, b.t, n.pages HAVING count(DISTINCT rid) >= {MIN_ON} AND count(DISTINCT rid) > n.pages * {RATIO}::DOUBLE),
k AS (SELECT b.rid, count(*) AS n_lines, count(*) FILTER (d.t IS NOT NULL) AS n_dropped, string_agg(b.line, chr(10) ORDER BY b.i) FILTER (d.t IS NULL) AS text
      FROM b LEFT JOIN d ON b.host IS NOT DISTINCT FROM d.host AND b.t = d.t GROUP BY b.rid)
SELECT p.page_id, p.host, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN p.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM p LEFT JOIN k ON p.rid = k.rid
"""
