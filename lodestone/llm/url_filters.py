"""URL filters by a temporal list join, in DataFrame functions only.

List entries are dated: an entry is added, removed, added again. Per list and pattern these events become validity
intervals. A capture is judged by the entries that were active when it was fetched, never by a later state of the list.
Each capture looks up the few keys its own URL gives (its host, every parent domain, every path prefix) by equality;
a pattern has one row with its whole history, in which the as-of step finds the interval that holds the fetch time.
So a pattern with a long history multiplies no rows, and a host with a third of all captures is a skewed join that AQE
splits.

A prefix is a host and the beginning of a path up to a slash, as h.com/ab/; one without a final slash stands for that
path and all below it, so h.com/ab holds h.com/ab and h.com/ab/c, but not h.com/abc. URLs without a path have no prefix. Hosts in brackets (IPv6) keep them.

The most specific active entry decides: path prefixes before hosts before domains, longer before shorter, and allow
before block.

Defined results: null or malformed URLs have no host and match nothing; a null fetch time matches nothing; null patterns
and events without a date are ignored; events of one pattern at one time count as one, a removal if any of them is; a
second addition in a row changes nothing; captures that repeat an id are judged each; of rules that tie in all this the
last by pattern, list and date decides; very long URLs are read whole; an empty list blocks nothing; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
RANKS = {"prefix": 3, "host": 2, "domain": 1}


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def intervals(events: DataFrame) -> DataFrame:
    """events (list, kind, pattern, action, change 'add' or 'remove', at) -> (list, kind, pattern, action, since, until); until is null while it lasts."""
    key = ["list", "kind", "pattern", "action"]
    at_once = events.where("pattern IS NOT NULL AND at IS NOT NULL").groupBy(*key, "at").agg(F.min(F.col("change") == "add").alias("on"))
    w = Window.partitionBy(*key).orderBy("at")  # the history of one entry
    turns = at_once.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    return turns.withColumn("until", F.lead("at").over(w)).where("on").select(*key, F.col("at").alias("since"), "until")


def keys_of(host: Column, path: Column) -> Column:
    """array<struct<kind, key>> of all patterns that could match."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    # "/a/b/c" -> "", "a", "b", "c": the prefixes "", "/", "/a", "/a/", "/a/b", "/a/b/" and the whole path
    parts = F.split(path, "/")
    closed = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    open_ = F.transform(closed, lambda c: F.substring(c, F.lit(1), F.length(c) - 1))
    prefixes = F.transform(F.array_distinct(F.array_append(F.concat(closed, open_), path)), lambda p: F.struct(F.lit("prefix").alias("kind"), F.concat(host, p).alias("key")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.concat(own, domains, F.when(path == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(prefixes)))


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (id, url, fetched_at) -> (id, host, fetched_at, n_active, blocked, rule_kind, rule, rule_action, since)."""
    history = intervals(events).groupBy("kind", F.col("pattern").alias("key")).agg(F.array_sort(F.collect_list(F.struct("since", "until", "list", "action"))).alias("history"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    asked = captures.select("id", "fetched_at", host.alias("host"), path.alias("path"))
    # Row numbers must not change between the two reads of asked, so they are written.
    asked = Scratch(captures.sparkSession, "captures").write(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    keyed = asked.where("host <> '' AND fetched_at IS NOT NULL").select("row", "fetched_at", F.explode(keys_of(F.col("host"), F.col("path"))).alias("k")).select("row", "fetched_at", "k.kind", "k.key")
    # Keys of all captures: Spark would guess their size by the compressed file of asked and broadcast them, so they are always merged.
    hits = keyed.hint("merge").join(history, ["kind", "key"])
    hits = hits.select("row", "kind", "key", F.explode(F.filter("history", lambda h: (h["since"] <= F.col("fetched_at")) & (h["until"].isNull() | (F.col("fetched_at") < h["until"])))).alias("h"))
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("kind")]
    order = F.struct(rank.alias("rank"), F.length("key").alias("long"), (F.col("h.action") == "allow").alias("allow"), F.col("key"), F.col("h.list").alias("list"), F.col("h.since").alias("since"), F.col("kind"), F.col("h.action").alias("action"))
    best = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.max(order).alias("best"))
    out = asked.join(best, "row", "left")
    return out.select(
        "id",
        "host",
        "fetched_at",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.kind").alias("rule_kind"),
        F.col("best.key").alias("rule"),
        F.col("best.action").alias("rule_action"),
        F.col("best.since").alias("since"),
    )


def _number(text: Column) -> Column:
    """A small number that any SQL engine can derive from a text."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def _day(n: Column) -> Column:
    return F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """pages has no fetch times: a minute of January 2024 from the page_id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(43200)).cast("int")
    return pages.select(F.col("page_id").alias("id"), "url", F.timestamp_add("MINUTE", minute, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("fetched_at"))


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path segments of pages: blocks come and go, some hosts are allowed."""
    url = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "^(/[^/]*/)", 1).alias("head")).where("host <> ''").distinct()
    hosts = url.select("host").distinct().withColumn("n", _number(F.col("host")))
    domains = url.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct().withColumn("n", _number(F.col("domain")))
    heads = url.where("head <> ''").select(F.concat("host", "head").alias("head")).withColumn("n", _number(F.col("head")))

    def event(df: DataFrame, name: str, kind: str, pattern: str, action: str, change: str, when: str, day: str) -> DataFrame:
        return df.where(when).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.col(pattern).alias("pattern"), F.lit(action).alias("action"), F.lit(change).alias("change"), _day(F.expr(day)).alias("at"))

    parts = [
        event(hosts, "hosts", "host", "host", "block", "add", "n % 4 = 0", "n % 20"),
        event(hosts, "hosts", "host", "host", "block", "remove", "n % 8 = 0", "n % 20 + 5"),
        event(hosts, "hosts", "host", "host", "block", "add", "n % 16 = 0", "n % 20 + 9"),
        event(hosts, "trusted", "host", "host", "allow", "add", "n % 7 = 3", "n % 11"),
        event(domains, "domains", "domain", "domain", "block", "add", "n % 5 = 0", "n % 25"),
        event(domains, "domains", "domain", "domain", "block", "remove", "n % 10 = 0", "n % 25 + 4"),
        event(heads, "paths", "prefix", "head", "block", "add", "n % 6 = 1", "n % 30"),
        event(heads, "paths", "prefix", "head", "allow", "add", "n % 9 = 2", "n % 30"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(sample_captures(pages), sample_events(pages)).withColumnRenamed("id", "page_id")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)', 1) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919 % 43200)::BIGINT) AS fetched_at
  FROM pages
), hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), domains AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 4))::INT AS n
  FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM p) WHERE domain <> ''
), heads AS (
  SELECT head, ('0x' || substr(md5(head), 1, 4))::INT AS n
  FROM (SELECT DISTINCT host || regexp_extract(path, '^(/[^/]*/)', 1) AS head FROM p
        WHERE host <> '' AND regexp_extract(path, '^(/[^/]*/)', 1) <> '')
), events AS (
  SELECT 'hosts' AS list, 'host' AS kind, host AS pattern, 'block' AS action, TRUE AS on_, n % 20 AS day FROM hosts WHERE n % 4 = 0
  UNION ALL SELECT 'hosts', 'host', host, 'block', FALSE, n % 20 + 5 FROM hosts WHERE n % 8 = 0
  UNION ALL SELECT 'hosts', 'host', host, 'block', TRUE, n % 20 + 9 FROM hosts WHERE n % 16 = 0
  UNION ALL SELECT 'trusted', 'host', host, 'allow', TRUE, n % 11 FROM hosts WHERE n % 7 = 3
  UNION ALL SELECT 'domains', 'domain', domain, 'block', TRUE, n % 25 FROM domains WHERE n % 5 = 0
  UNION ALL SELECT 'domains', 'domain', domain, 'block', FALSE, n % 25 + 4 FROM domains WHERE n % 10 = 0
  UNION ALL SELECT 'paths', 'prefix', head, 'block', TRUE, n % 30 FROM heads WHERE n % 6 = 1
  UNION ALL SELECT 'paths', 'prefix', head, 'allow', TRUE, n % 30 FROM heads WHERE n % 9 = 2
), spans AS (
  SELECT list, kind, pattern, action, on_, TIMESTAMP '2024-01-01' + to_days(day::INT) AS since,
         lead(TIMESTAMP '2024-01-01' + to_days(day::INT)) OVER (PARTITION BY list, kind, pattern, action ORDER BY day) AS until
  FROM events
), hits AS (
  SELECT p.page_id, s.*, CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS rank,
         row_number() OVER (PARTITION BY p.page_id ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
                            length(pattern) DESC, action = 'allow' DESC, pattern DESC, list DESC, since DESC) AS rn,
         count(*) OVER (PARTITION BY p.page_id) AS n_active
  FROM p JOIN spans s ON s.on_ AND s.since <= p.fetched_at AND (s.until IS NULL OR p.fetched_at < s.until) AND p.host <> '' AND
    CASE s.kind WHEN 'host' THEN p.host = s.pattern WHEN 'domain' THEN p.host = s.pattern OR ends_with(p.host, '.' || s.pattern)
         ELSE p.path <> '' AND (p.host || p.path = s.pattern OR starts_with(p.host || p.path, regexp_replace(s.pattern, '/$', '') || '/')) END
)
SELECT p.page_id, p.host, p.fetched_at, coalesce(h.n_active, 0)::BIGINT AS n_active, coalesce(h.action = 'block', FALSE) AS blocked,
       h.kind AS rule_kind, h.pattern AS rule, h.action AS rule_action, h.since
FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.rn = 1
"""
