"""URL filters by a temporal list join (built-in functions only).

A list is a dated history of entries: on a date a pattern is added to a list or taken off it. Each pattern's history
becomes validity intervals, gathered to one row per pattern. A pattern is a host, alone or with a path of whole segments;
it covers the host and all below it, and the path and all below it. Hosts are compared in lower case, paths as they are.
A capture proposes keys of the patterns that could cover it: of its host's last labels and of prefixes of its path, for
those numbers of labels and segments that the list has (a few small numbers; the longest pattern bounds how many). A
path's prefixes are hashed in one running pass. The join is by key, and what it finds is compared as text, so a hash that
two patterns share does no harm; then the as-of condition asks whether an interval holds at fetch time. So a join finds
one row per pattern at most, and hot hosts are split by Spark's skew join or meet a side whose size Spark has checked.

Defined cases: a URL without a host (null, malformed) is allowed; a null fetch time is never inside an interval; of
several entries of a pattern and list at the same time the removal counts; repeated captures are judged each for
itself; an empty list allows all; a path ends at its first empty segment; URLs of any length and depth take
time in proportion to their length; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galewatch.functions.bind import held
from galewatch.llm.common import stored, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+((?:/[^/?#]+)*)"
#: The same for Java's engine, which follows a repeated group of variable length by recursion unless it is possessive.
JAVA_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]++((?:/[^/?#]++)*+)"
JAVA_PATTERN_PATH = r"^[^/]*+((?:/[^/?#]++)*+)"


def normal(pattern: Column) -> Column:
    return F.concat(F.lower(F.substring_index(pattern, "/", 1)), F.regexp_extract(pattern, JAVA_PATTERN_PATH, 1))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, list, action ('add' or 'remove'), at -> pattern, spans array<struct<list, since, until>>; until is
    exclusive, null where still valid."""
    told = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull()).groupBy(normal(F.col("pattern")).alias("pattern"), "list", "at").agg(F.min(F.col("action") == "add").alias("on"))
    step = Window.partitionBy("pattern", "list").orderBy("at")
    told = told.withColumn("was", F.coalesce(F.lag("on").over(step), F.lit(False))).where(F.col("on") != F.col("was"))
    spans = told.select("pattern", "list", F.col("at").alias("since"), "on", F.lead("at").over(step).alias("until")).where("on")
    return spans.groupBy("pattern").agg(F.collect_list(F.struct("list", "since", "until")).alias("spans"))


def segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(path, F.lit(2)), "/"))


def prefix_hashes(path: Column, depths: list[int]) -> Column:
    """The hash of each prefix of `depths` segments (ascending, above 0) that the path has, that of the host alone first."""
    steps = F.array(*[F.struct(F.lit(a).alias("after"), F.lit(b).alias("upto")) for a, b in zip([0, *depths], depths)]).cast("array<struct<after:int,upto:int>>")
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array(F.lit(0).cast("long")).alias("all"))

    def longer(parts: Column, told: Column, s: Column) -> Column:
        own = F.xxhash64(told["last"], F.array_join(F.slice(parts, s["after"] + 1, s["upto"] - s["after"]), "/"))
        return held(own, lambda h: F.struct(h.alias("last"), F.concat(told["all"], F.array(h)).alias("all")))

    return held(segments(path), lambda parts: F.aggregate(F.filter(steps, lambda s: s["upto"] <= F.size(parts)), start, lambda told, s: longer(parts, told, s))["all"])


def pattern_keys(host: Column, path: Column, labels: list[int], depths: list[int]) -> Column:
    """A key for each of the host's last `labels` labels with each of the path's prefixes."""
    domains = F.filter(F.array(*map(F.lit, labels)).cast("array<int>"), lambda n: n <= F.size(F.split(host, r"\.")))
    named = F.transform(domains, lambda n: F.xxhash64(F.call_function("substring_index", host, F.lit("."), -n)))
    return held(prefix_hashes(path, depths), lambda prefixes: F.flatten(F.transform(named, lambda d: F.transform(prefixes, lambda q: F.xxhash64(d, q)))))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """id, url, fetched_at (timestamp) -> id, url, fetched_at, lists (sorted names that hold then), blocked."""
    host, path = F.lower(F.regexp_extract("url", HOST, 1)), F.regexp_extract("url", JAVA_PATH, 1)
    own = validity(entries).withColumn("own_host", F.substring_index("pattern", "/", 1)).withColumn("own_path", F.substr("pattern", F.length("own_host") + 1))
    own = stored(own.withColumn("labels", F.size(F.split("own_host", r"\."))).withColumn("depth", F.size(segments(F.col("own_path")))), "url_patterns")
    # A row per number: at most as many as the longest pattern has labels and segments.
    shape = own.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("depth")).alias("depths")).first()
    labels, depths = list(shape["labels"]), [d for d in shape["depths"] if d > 0]
    # A pattern is its own longest prefix of its own host.
    own = own.withColumn("key", F.xxhash64(F.xxhash64("own_host"), F.element_at(prefix_hashes(F.col("own_path"), depths), -1)))
    rows = captures.select("id", "url", "fetched_at")
    keys = F.when(F.coalesce(host, F.lit("")) != "", pattern_keys(host, path, labels, depths))
    # Looked up by distinct (key, fetch time), and joined back by capture only where something holds.
    asked = rows.where(F.col("fetched_at").isNotNull()).select("url", "fetched_at", F.explode(keys).alias("key")).distinct()
    below = (F.col("own_path") == "") | (path == F.col("own_path")) | path.startswith(F.concat("own_path", F.lit("/")))
    covered = ((host == F.col("own_host")) | host.endswith(F.concat(F.lit("."), F.col("own_host")))) & below
    met = asked.join(own, "key").where(covered)
    met = met.select("url", "fetched_at", F.explode(F.filter("spans", lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (F.col("fetched_at") < s["until"])))).alias("s"))
    met = met.groupBy("url", "fetched_at").agg(F.array_sort(F.collect_set("s.list")).alias("lists"))
    out = rows.join(met, ["url", "fetched_at"], "left")
    return out.select("id", "url", "fetched_at", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))


#: The tables have neither fetch times nor lists: both follow from ids and hosts by rule, alike in Spark and SQL.
START = "2024-01-01"


def last_three(host: Column) -> Column:
    """The last three labels of a host that has them, else nothing."""
    return held(F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), F.split(host, r"\.")), -3, 3), lambda x: F.when(F.forall(x, lambda y: y != ""), F.array_join(x, ".")).otherwise(""))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.unix_timestamp(F.lit(START), "yyyy-MM-dd") + F.pmod(F.col("id") * 7919, F.lit(366)) * 86400))
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).where("host <> ''").distinct()
    draw = lambda salt, n: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), "host")), 1, 7), 16, 10).cast("long"), F.lit(n))
    day = lambda d: F.timestamp_seconds(F.unix_timestamp(F.lit(START), "yyyy-MM-dd") + d * 86400)
    one = hosts.where(draw("list", 4) == 0).select(F.col("host").alias("pattern"), F.lit("spam").alias("list"), draw("add", 200).alias("d"), draw("stay", 120).alias("n"))
    two = hosts.where(draw("path", 3) == 0).select(F.concat("host", F.lit("/de")).alias("pattern"), F.lit("adult").alias("list"), draw("add2", 300).alias("d"), draw("stay2", 60).alias("n"))
    three = hosts.select(last_three(F.col("host")).alias("host")).where("host <> ''").distinct().where(draw("parent", 5) == 0).select(F.col("host").alias("pattern"), F.lit("malware").alias("list"), draw("add3", 250).alias("d"), draw("stay3", 90).alias("n"))
    deep = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.regexp_extract("url", JAVA_PATH, 1).alias("path")).where("host <> '' and path like '/_%/_%'")
    deep = deep.select(F.concat(last_three(F.col("host")), F.col("path")).alias("host")).where("host not like '/%'").distinct()
    four = deep.where(draw("deep", 3) == 0).select(F.col("host").alias("pattern"), F.lit("scam").alias("list"), draw("add4", 250).alias("d"), draw("stay4", 110).alias("n"))
    both = one.unionByName(two).unionByName(three).unionByName(four)
    entries = both.select("pattern", "list", F.lit("add").alias("action"), day(F.col("d")).alias("at")).unionByName(both.select("pattern", "list", F.lit("remove").alias("action"), day(F.col("d") + F.col("n") + 1).alias("at")))
    return filter_urls(captures, entries).select(F.col("id").alias("page_id"), F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), F.array_join("lists", ",").alias("lists"), "blocked")


ORACLE = rf"""
WITH p AS (SELECT page_id, url, TIMESTAMP '{START}' + to_days(CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched_at, lower(regexp_extract(url, '{HOST}', 1)) AS host,
                  regexp_extract(url, '{PATH}', 1) AS path FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
q AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS host FROM h WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
w AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) || path AS host FROM p WHERE path LIKE '/_%/_%' AND regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
e AS (
  SELECT host AS pattern, 'spam' AS list, ('0x' || md5('add' || host)[1:7])::BIGINT % 200 AS d, ('0x' || md5('stay' || host)[1:7])::BIGINT % 120 AS n FROM h WHERE ('0x' || md5('list' || host)[1:7])::BIGINT % 4 = 0
  UNION ALL SELECT host || '/de', 'adult', ('0x' || md5('add2' || host)[1:7])::BIGINT % 300, ('0x' || md5('stay2' || host)[1:7])::BIGINT % 60 FROM h WHERE ('0x' || md5('path' || host)[1:7])::BIGINT % 3 = 0
  UNION ALL SELECT host, 'malware', ('0x' || md5('add3' || host)[1:7])::BIGINT % 250, ('0x' || md5('stay3' || host)[1:7])::BIGINT % 90 FROM q WHERE ('0x' || md5('parent' || host)[1:7])::BIGINT % 5 = 0
  UNION ALL SELECT host, 'scam', ('0x' || md5('add4' || host)[1:7])::BIGINT % 250, ('0x' || md5('stay4' || host)[1:7])::BIGINT % 110 FROM w WHERE ('0x' || md5('deep' || host)[1:7])::BIGINT % 3 = 0),
v AS (SELECT split_part(pattern, '/', 1) AS host, regexp_extract(pattern, '^[^/]*(.*)$', 1) AS path, list,
             TIMESTAMP '{START}' + to_days(CAST(d AS INTEGER)) AS since, TIMESTAMP '{START}' + to_days(CAST(d + n + 1 AS INTEGER)) AS until FROM e),
m AS (SELECT DISTINCT p.page_id, v.list FROM p JOIN v ON p.fetched_at >= v.since AND p.fetched_at < v.until
      AND (p.host = v.host OR ends_with(p.host, '.' || v.host)) AND (v.path = '' OR p.path = v.path OR starts_with(p.path, v.path || '/'))),
g AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM m GROUP BY page_id)
SELECT p.page_id, CAST(CAST(p.fetched_at AS DATE) AS VARCHAR) AS fetched_on, coalesce(g.lists, '') AS lists, g.lists IS NOT NULL AS blocked FROM p LEFT JOIN g ON p.page_id = g.page_id
"""
