"""URL filters by a temporal list join.

Dated list entries (a pattern is added to or removed from a list on a day) become validity
intervals: from the day of an addition to the day of the pattern's next entry. Every capture is then
held, as of the day it was fetched, against the intervals of all patterns that cover its URL: its
host, the domains above it, and the prefixes of its path, segment by segment. Of the active entries
the longest pattern decides; between equally long ones, an allow list does.

The as-of join is an equi-join on pattern and month with a range condition: an interval has a row
for each month in which captures were fetched, so a host with a third of all captures is cut by
month, needs no window over its captures, and what remains can be split by Spark. Entries are
first reduced to one per list, pattern and day, which bounds the windows by the number of days.
Captures are reduced to distinct (url, day) before, and joined back after.

Everything is built-in expressions. Defined results: a null or malformed url has no host and is
never blocked; a null day is before all entries; a pattern added and removed on the same day is not
active; entries with a null pattern, list or day are ignored; repeated rows are decided alike; empty
tables give empty results or unblocked captures; other columns of the captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.words import table
from firnline.staging import stage

MONTH = 32  # days that share a row of an interval


def host_of(url: Column) -> Column:
    return F.regexp_extract(
        F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: str, depth: Column) -> Column:
    """Host, domains above it and path prefixes of at most `depth` segments, as an array."""
    host, labels = host_of(F.col(url)), F.split(host_of(F.col(url)), r"\.")
    segments = F.filter(F.split(path_of(F.col(url)), "/"), lambda s: s != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    deepest = F.least(F.size(segments), depth)
    prefixes = F.when(
        deepest > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(deepest, F.lit(1))),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """`entries` has list, allow, pattern, day, added; returns list, allow, pattern, first, next (null: open)."""
    days = (
        entries.dropna(subset=["list", "pattern", "day"])
        .groupBy("list", "pattern", "day")
        .agg(F.min("added").alias("added"), F.max("allow").alias("allow"))  # a removal on the day wins
    )
    following = Window.partitionBy("list", "pattern").orderBy("day")
    return (
        days.withColumn("next", F.lead("day").over(following))
        .where("added")
        .select("list", "allow", "pattern", F.col("day").alias("first"), "next")
    )


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """Adds to `captures`: n_active, decided_by and blocked. Days are whole numbers."""
    valid = stage(intervals(entries))
    depth = F.size(F.split("pattern", "/")) - 1
    deepest = valid.agg(F.coalesce(F.max(depth), F.lit(0))).first()[0]
    row = captures.select(F.struct("*").alias("_row"))
    row = row.withColumns({"_u": F.col(f"_row.`{url}`"), "_d": F.col(f"_row.`{day}`").cast("long")})
    asked = stage(row.where(F.col("_u").isNotNull() & F.col("_d").isNotNull()).select("_u", "_d").distinct())
    low, high = asked.agg(F.min("_d"), F.max("_d")).first()
    # Only the months that captures can ask about get rows.
    begin = F.greatest(F.col("first"), F.lit(low or 0))
    end = F.least(F.coalesce(F.col("next") - 1, F.lit(high or 0)), F.lit(high or 0))
    month = lambda c: F.floor(c / MONTH).cast("long")
    monthly = valid.where(begin <= end).withColumn("_m", F.explode(F.sequence(month(begin), month(end))))
    keys = asked.select("_u", "_d", F.explode(patterns_of("_u", F.lit(deepest))).alias("_p"))
    hits = keys.join(
        monthly,
        (F.col("_p") == F.col("pattern")) & (month(F.col("_d")) == F.col("_m"))
        & (F.col("_d") >= F.col("first")) & (F.col("next").isNull() | (F.col("_d") < F.col("next"))),
    )
    decided = hits.groupBy("_u", "_d").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.max(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("_best"),
    )
    known = decided.select(
        F.col("_u").alias("_ku"), F.col("_d").alias("_kd"), "n_active", F.col("_best.pattern").alias("decided_by"),
        (~F.col("_best.allow")).alias("blocked"),
    )
    return row.join(known, (F.col("_u") == F.col("_ku")) & (F.col("_d") == F.col("_kd")), "left").select(
        "_row", F.coalesce("n_active", F.lit(0)).alias("n_active"), "decided_by",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day, which the table lacks: derived from the page_id."""
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % 730).alias("day"))


def _entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the pages: each has its host, domain or path put on a list and, three
    times out of four, taken off again; spam hosts are listed for good."""
    p, host = F.col("page_id"), host_of(F.col("url"))
    path = F.array_join(F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != ""), "/")
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    pattern = (
        F.when(p % 97 == 0, domain).when((p % 11 == 0) | host.startswith("spam"), host)
        .when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))
    )
    first = F.when(host.startswith("spam"), F.lit(0).cast("long")).otherwise(p * 104729 % 730)
    listed = pages.where((host != "") & p.isNotNull()).select(
        F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("trusted")), (p % 3 + 1).cast("int")).alias("list"),
        pattern.alias("pattern"), first.alias("first"),
        F.when((p % 4 != 0) & ~host.startswith("spam"), first + 30 + p * 31 % 200).alias("last"),
    )
    day = F.explode(
        F.array(F.struct(F.col("first").alias("day"), F.lit(True).alias("added")), F.struct(F.col("last").alias("day"), F.lit(False).alias("added")))
    )
    return listed.select("list", (F.col("list") == "trusted").alias("allow"), "pattern", day.alias("e")).select(
        "list", "allow", "pattern", "e.day", "e.added"
    )


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(_captures(pages), _entries(pages)).select(
        "_row.page_id", "_row.day", "n_active", "decided_by", "blocked"
    )


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id * 7919 % 730 AS day,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'),
      lambda s: s <> '') AS segments
  FROM pages
), listed AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'spam' WHEN 1 THEN 'adult' ELSE 'trusted' END AS list,
    CASE WHEN page_id % 97 = 0 THEN array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.')
      WHEN page_id % 11 = 0 OR host LIKE 'spam%' OR len(segments) = 0 THEN host
      ELSE host || '/' || array_to_string(segments, '/') END AS pattern,
    CASE WHEN host LIKE 'spam%' THEN 0 ELSE page_id * 104729 % 730 END AS first,
    CASE WHEN page_id % 4 <> 0 AND host NOT LIKE 'spam%' THEN page_id * 104729 % 730 + 30 + page_id * 31 % 200 END AS last
  FROM p WHERE host <> '' AND page_id IS NOT NULL
), events AS (
  SELECT list, pattern, day, bool_and(added) AS added FROM (
    SELECT list, pattern, first AS day, true AS added FROM listed
    UNION ALL SELECT list, pattern, last, false FROM listed WHERE last IS NOT NULL)
  GROUP BY ALL
), valid AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS next FROM events) WHERE added
), hits AS (
  SELECT p.page_id, p.day, v.list, v.pattern,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pattern) DESC, v.list = 'trusted' DESC, v.pattern DESC) AS rank
  FROM p JOIN valid v ON p.day >= v.day AND (v.next IS NULL OR p.day < v.next) AND p.host <> ''
    AND (p.host = v.pattern OR (ends_with(p.host, ('.' || v.pattern)) AND contains(v.pattern, '.'))
      OR (contains(v.pattern, '/')
        AND starts_with((p.host || '/' || array_to_string(p.segments, '/') || '/'), (v.pattern || '/'))))
)
SELECT p.page_id, p.day, count(h.page_id) AS n_active, max(h.pattern) FILTER (rank = 1) AS decided_by,
  coalesce(bool_or(h.list <> 'trusted') FILTER (rank = 1), false) AS blocked
FROM p LEFT JOIN hits h ON h.page_id = p.page_id GROUP BY p.page_id, p.day"""
