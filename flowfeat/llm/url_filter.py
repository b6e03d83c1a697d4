"""Operator 3, URL filters: a temporal join of captures with dated list entries, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, table

FOREVER = "9999-12-31 00:00:00"
HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without port, user or closing dots; empty if the text is no absolute URL."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def url_keys(host: Column, path: Column, labels_most: int, parts_most: int) -> Column:
    """All list keys that can match a URL: its host, the host's parent domains, and host with each leading part of its path.

    ``labels_most`` and ``parts_most``: labels of the longest domain entry and path parts of the longest prefix entry; longer keys match
    none, and all of them would take the square of a long URL.
    """
    labels = F.split(host, r"\.")
    parts = F.slice(path_parts(path), 1, parts_most) if parts_most else F.array().cast("array<string>")
    first, last = F.greatest(F.lit(1), F.size(labels) - labels_most + 1), F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (kind, pattern, action add|remove, effective_at) as intervals [valid_from, valid_to) of activity.

    A later entry of the same kind and pattern ends the one before it. Of entries of one instant a removal prevails.
    Entries with a null kind, pattern, action or time, or another action, are void.
    """
    clean = entries.filter(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("action").isin("add", "remove") & F.col("effective_at").isNotNull())
    clean = clean.select(F.concat_ws(":", "kind", "pattern").alias("__key"), "effective_at", "action").groupBy("__key", "effective_at").agg((F.max("action") == "add").alias("__on"))
    end = F.lead("effective_at", 1, None).over(Window.partitionBy("__key").orderBy("effective_at"))
    return clean.withColumn("valid_to", F.coalesce(end, F.lit(FOREVER).cast("timestamp"))).filter("__on").select("__key", F.col("effective_at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per distinct (id, url, time) of captures: ``host``, ``blocked``, ``n_rules`` and ``rules`` (sorted keys) active at fetch time.

    The as-of rule is an equi-join on the list key with the interval that holds the fetch time; intervals of a key do
    not overlap, so a capture meets each key once at most. Only ids, keys and times are shuffled; a host with a
    third of all captures is a skewed key of a plain join, which Spark splits. Null, empty or relative URLs and null
    times match nothing and are not blocked. Repeated rows give one row. An empty list blocks nothing. Columns other than the three
    named ones are not looked at.
    """
    spans = cut(validity(entries), "spans")
    longest = spans.agg(
        F.max(F.when(F.col("__key").startswith("domain:"), F.size(F.split("__key", r"\.")))).alias("labels"),
        F.max(F.when(F.col("__key").startswith("prefix:"), F.size(path_parts(F.col("__key"))) - 1)).alias("parts"),
    ).first()
    base = captures.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(time_col).cast("timestamp").alias("__at"))
    host, path = url_host(F.col("__url")), F.coalesce(F.regexp_extract("__url", PATH, 1), F.lit(""))
    keyed = base.withColumns({"__host": host, "__path": path}).select("__id", "__url", "__host", "__at", F.explode_outer(url_keys(F.col("__host"), F.col("__path"), longest["labels"] or 0, longest["parts"] or 0)).alias("__key"))
    hit = keyed.join(spans, (keyed["__key"] == spans["__key"]) & (keyed["__at"] >= F.col("valid_from")) & (keyed["__at"] < F.col("valid_to")), "left")
    rules = F.array_sort(F.collect_set(F.when(F.col("valid_from").isNotNull(), keyed["__key"])))
    return (
        hit.groupBy("__id", "__url", "__at", "__host")
        .agg(rules.alias("rules"))
        .select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.col("__at").alias(time_col), F.col("__host").alias("host"), (F.size("rules") > 0).alias("blocked"), F.size("rules").cast("long").alias("n_rules"), "rules")
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _minutes(n: Column) -> Column:
    return F.timestamp_seconds(n * 60 + 1704067200)


def page_captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch time: one in 2024 is taken from the id."""
    return pages.select("page_id", "url", _minutes(F.col("page_id") * 7919 % 525600).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts, domains and first path parts, each added and removed on days taken from its MD5."""
    at = pages.select(url_host(F.col("url")).alias("h"), F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")).alias("p")).filter("h <> ''")
    first = F.regexp_extract("p", r"^/*([^/]+)", 1)
    named = (
        at.select(F.lit("host").alias("kind"), F.col("h").alias("pattern"))
        .union(at.select(F.lit("domain"), F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)))
        .union(at.select(F.lit("prefix"), F.when(first != "", F.concat_ws("/", "h", first))))
        .filter("pattern <> ''")
        .distinct()
        .withColumn("n", _number(F.concat_ws(":", "kind", "pattern")))
        .filter("n % 4 = 0")
    )
    add = _minutes(F.expr("n div 4 % 300") * 1440)
    gone = _minutes((F.expr("n div 4 % 300") + 1 + F.expr("n div 1200 % 90")) * 1440)
    return named.select("kind", "pattern", F.lit("add").alias("action"), add.alias("effective_at")).union(named.filter("n % 3 <> 0").select("kind", "pattern", F.lit("remove"), gone))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_filter(page_captures(pages), page_entries(pages))
    return out.select("page_id", "host", "fetched_at", "blocked", "n_rules", F.array_join("rules", " ").alias("rules"))


OP3_SQL = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, rtrim(lower(regexp_extract(coalesce(url, ''), '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
         regexp_extract(coalesce(url, ''), '^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1) AS path,
         TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at
  FROM pages
), named AS (
  SELECT 'host' AS kind, host AS pattern FROM p WHERE host <> ''
  UNION SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p WHERE host <> ''
  UNION SELECT 'prefix', host || '/' || regexp_extract(path, '^/*([^/]+)', 1) FROM p WHERE host <> '' AND regexp_extract(path, '^/*([^/]+)', 1) <> ''
), n AS (
  SELECT *, ('0x' || substr(md5(kind || ':' || pattern), 1, 8))::BIGINT AS n FROM named WHERE pattern <> ''
), spans AS (
  SELECT kind || ':' || pattern AS key, TIMESTAMP '2024-01-01' + to_days(((n // 4) % 300)::INT) AS a,
         CASE WHEN n % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((((n // 4) % 300) + 1 + ((n // 1200) % 90))::INT) ELSE TIMESTAMP '9999-12-31' END AS b
  FROM n WHERE n % 4 = 0
), lab AS (
  SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM p
), keys AS (
  SELECT page_id, host, fetched_at, 'host:' || host AS key FROM lab WHERE host <> ''
  UNION SELECT page_id, host, fetched_at, 'domain:' || array_to_string(ls[i:], '.') FROM (SELECT *, unnest(range(1, greatest(len(ls), 2))) AS i FROM lab) WHERE host <> ''
  UNION SELECT page_id, host, fetched_at, 'prefix:' || host || '/' || array_to_string(ps[1:i], '/') FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM lab) WHERE host <> ''
)
SELECT p.page_id, p.host, p.fetched_at, count(s.key) > 0 AS blocked, count(s.key) AS n_rules,
       coalesce(string_agg(s.key, ' ' ORDER BY s.key), '') AS rules
FROM p LEFT JOIN keys k ON k.page_id = p.page_id LEFT JOIN spans s ON s.key = k.key AND k.fetched_at >= s.a AND k.fetched_at < s.b
GROUP BY p.page_id, p.host, p.fetched_at
"""
