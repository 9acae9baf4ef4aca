"""URL filters over time: dated list entries become validity intervals, captures are joined as of their fetch time.

A list is a log: at listed_at a pattern of some kind is added to or removed from it. An entry is valid from
an add until the next row of the same list, kind and pattern. Kinds: `host` (exactly this host), `domain`
(this host and all below it), `prefix` (host and path begin so, at whole path segments). A capture is
looked up by all its own keys (host, its parent domains, its path prefixes), so the join is on equal (kind,
pattern, period), never on patterns against URLs. Periods are fixed spans of PERIOD_DAYS: an interval is
repeated for each period that it touches up to the last capture, so a key's long history doesn't meet all
captures of a hot host, only that of the same period.

A list of up to BROADCAST_ROWS such rows, which are counted, is sent to all tasks and no key of a capture is shuffled.
Of a longer one, every row is repeated for SALTS parts of the captures, so that those of a hot key meet in as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 64
BROADCAST_ROWS, SALTS = 200_000, 32


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a final dot; empty where there is none."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.lower(F.rtrim(host, F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """All (kind, pattern) that can match a URL."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat_ws("/", host, F.slice(parts, 1, i)))
    keyed = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))),
        F.transform(F.array_distinct(domains), lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("pattern"))),
        F.transform(F.array_distinct(prefixes), lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern"))),
    )
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(keyed)


def intervals(entries: DataFrame) -> DataFrame:
    """entries(list, kind, pattern, action `add` or `remove`, listed_at) as (list, kind, pattern, valid_from, valid_to).

    valid_to is open (null) where nothing follows. Of rows with one list, kind, pattern and time the removal
    counts. Rows with a null in one of these columns, or another action, are left out; adding again what
    is listed goes on with it.
    """
    fields = ["list", "kind", "pattern", "action", "listed_at"]
    rows = entries.select(*fields).dropna().where(F.col("action").isin("add", "remove"))
    rows = rows.groupBy("list", "kind", F.lower("pattern").alias("pattern"), "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("listed_at")
    changes = rows.withColumn("before", F.lag("action").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    spans = changes.withColumn("valid_to", F.lead("listed_at").over(w)).where("action = 'add'")
    return spans.select("list", "kind", "pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def _period(at: Column) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / PERIOD_DAYS)


def filter_urls(captures: DataFrame, entries: DataFrame, allow: tuple[str, ...] = ("allow",), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate captures(page_id, url, fetched_at) against the entries active at fetched_at (from valid_from, before valid_to).

    Returns a row per row of captures: page_id, url, fetched_at, host, n_hits, lists (sorted names), blocked
    (hits on a list, but on none named in `allow`). Null or hostless URLs and null times have no hits and
    are not blocked; repeated rows repeat; other columns are ignored; an empty list blocks nothing.
    """
    rows = captures.select("page_id", "url", "fetched_at", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    last = captures.agg(F.max("fetched_at")).first()[0]
    spans = intervals(entries).where(F.col("valid_from") <= F.lit(last).cast("timestamp"))
    until = F.least(F.coalesce("valid_to", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    spans = spans.withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), _period(until))))
    # one evaluation for all captures of a host, path and day-second: pre-aggregation takes the heat from hot hosts
    asked = rows.where("host <> '' and fetched_at is not null").select("host", "path", "fetched_at").distinct()
    keyed = asked.withColumn("period", _period(F.col("fetched_at"))).select("*", F.inline(keys_of(F.col("host"), F.col("path"))))
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        both = keyed.join(F.broadcast(spans), ["kind", "pattern", "period"])
    else:
        part = F.pmod(F.xxhash64("host", "path", "fetched_at"), F.lit(SALTS)).cast("int")
        spread = spans.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
        both = keyed.withColumn("part", part).join(spread, ["kind", "pattern", "period", "part"]).drop("part")
    hits = both.where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    found = hits.groupBy("host", "path", "fetched_at").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_set("list")).alias("lists"))
    out = rows.join(found, ["host", "path", "fetched_at"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    blocked = (F.size(lists) > 0) & ~F.arrays_overlap(lists, F.array(*map(F.lit, allow)).cast("array<string>"))
    return out.select("page_id", "url", "fetched_at", "host", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), lists.alias("lists"), blocked.alias("blocked"))
