"""URL filters by dated lists: a temporal list join (operator 4), by SQL functions only.

List entries are dated: at ``ts`` a list adds or removes a domain. They become validity intervals: an addition holds
until the next entry of the same list and domain. Every capture (a URL with the time it was fetched) is then evaluated
against the entries that were active at that time, for its host and all parent domains.

Entries of a domain are ordered inside time bins and carried across bins by the first entry of the next bin that has
any, so a domain with a third of all entries is as many tasks as it has bins. Intervals are cut at bins of
``BIN_DAYS``, and captures meet them on (domain, bin): at most one interval of a list and domain holds at a time, so a
capture gets at most one row per list and label of its host. Of entries of one list, domain and time the last by
``seq`` counts.

A capture without a host or a fetch time matches nothing. Every row of the input gives one row, repeated rows alike.
Entries with a null list, domain or time take no part. Other columns are ignored. Empty lists filter nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kubestrata.llm.store import staged

BIN_DAYS = 7
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def _bin(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / (86400 * BIN_DAYS)).cast("long")


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, domain, ts timestamp, seq long, active boolean) -> (list, domain, since, until); until may be null."""
    known = entries.where(F.col("list").isNotNull() & F.col("domain").isNotNull() & F.col("ts").isNotNull())
    known = known.select("list", F.lower("domain").alias("domain"), "ts", "seq", "active", _bin(F.col("ts")).alias("bin"))
    inside = Window.partitionBy("list", "domain", "bin").orderBy("ts", "seq")
    known = staged(known.withColumn("next", F.lead("ts").over(inside)), "entries")
    firsts = known.groupBy("list", "domain", "bin").agg(F.min("ts").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("list", "domain").orderBy("bin"))).drop("first")
    joined = known.join(staged(later, "bins"), ["list", "domain", "bin"])
    until = F.coalesce("next", "later")
    return joined.where("active").select("list", "domain", F.col("ts").alias("since"), until.alias("until")).where(F.col("until").isNull() | (F.col("since") < F.col("until")))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) -> page_id, host, fetched_at, blocked, n_entries, entry, list, since.

    ``entry``, ``list``, ``since``: the active entry for the longest domain, of equal ones the first list by name.
    """
    rows = staged(captures.select("page_id", host_of(F.col("url").cast("string")).alias("host"), "fetched_at").withColumn("row", F.monotonically_increasing_id()), "captures")
    valid = intervals(entries)
    end = staged(rows.agg(F.max(_bin(F.col("fetched_at"))).alias("last")), "horizon").first()["last"]
    if end is None:
        end = 0
    upto = F.least(F.coalesce(_bin(F.col("until")), F.lit(end)), F.lit(end))
    cut = staged(valid.where(_bin(F.col("since")) <= end).withColumn("bin", F.explode(F.sequence(_bin(F.col("since")), upto))), "intervals")
    labels = F.split("host", r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).select(
        "row", "fetched_at", F.explode(domains).alias("domain"), _bin(F.col("fetched_at")).alias("bin"))
    hits = asked.join(cut, ["domain", "bin"]).where((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    strongest = F.min(F.struct((-F.length("domain")).alias("long"), "list", "domain", "since"))
    per_row = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n"), strongest.alias("best"))
    return rows.join(per_row, "row", "left").select(
        "page_id", "host", "fetched_at", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.domain").alias("entry"), F.col("best.list").alias("list"), F.col("best.since").alias("since"))


def captures_and_entries(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dated lists of the test tables: an event adds the host of the page with its user's number to a list, or its
    parent domain; an error takes it off. A page was fetched at a second of January 2024 that its number tells."""
    captures = pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(2592000))).alias("fetched_at"))
    hosts = pages.select(F.col("page_id").alias("user_id"), host_of(F.col("url")).alias("host"))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    entries = events.join(hosts, "user_id").select(
        F.concat(F.lit("list"), (F.col("event_id") % 3).cast("string")).alias("list"), F.when(F.col("event_id") % 50 == 0, parent).otherwise(F.col("host")).alias("domain"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("active"))
    return captures, entries


ORACLE = r"""
WITH c AS (
  SELECT page_id, row_number() OVER () AS id, make_timestamp((1704067200 + (page_id * 7919) % 2592000) * 1000000) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host FROM pages),
e AS (
  SELECT 'list' || (event_id % 3) AS list, CASE WHEN event_id % 50 = 0 THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END AS domain, ts, event_id,
    event_type <> 'error' AS active FROM events JOIN (SELECT page_id AS user_id, host FROM c) USING (user_id)),
i AS (SELECT *, lead(ts) OVER (PARTITION BY list, domain ORDER BY ts, event_id) AS until FROM e WHERE domain IS NOT NULL),
m AS (SELECT id, i.list, i.domain, i.ts AS since FROM c JOIN i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND i.active
        AND i.ts <= c.fetched_at AND (i.until IS NULL OR c.fetched_at < i.until)),
b AS (SELECT id, count(*) AS n, min({'long': -length(domain), 'list': list, 'domain': domain, 'since': since}) AS best FROM m GROUP BY id)
SELECT page_id, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, best['domain'] AS entry, best['list'] AS list, best['since'] AS since
FROM c LEFT JOIN b USING (id)
"""
