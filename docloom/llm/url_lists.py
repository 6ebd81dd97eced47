"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (add or remove a pattern) become validity intervals, one row each. Every capture looks up its
host, the domains above it and its path prefixes in an as-of join: a listed pattern of its own whose interval holds at
its fetch time. A list that is small, as counted in bytes, is broadcast, so captures aren't dealt by pattern at all; a larger one
is joined by shuffles in which the look-ups of a popular pattern are split over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, spread_join

#: Bytes of a list that is broadcast, at the most, and about what a row takes beside its texts.
BROADCAST_BYTES, ROW_BYTES = 100_000_000, 48
#: Fixed value: scheme, user, host, port and path of a URL.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def validity(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until: from when on and before when an entry holds, until null where it still does.

    Entries: list, kind (host, domain, prefix), pattern, action (add, remove), dated. On one date a removal
    wins over an addition; additions while listed and removals while not listed change nothing. Rows with
    a null are left out; repeated rows count once; other columns are ignored; an empty table gives an empty one.
    """
    one = entries.select("list", "kind", "pattern", "dated", (F.col("action") == "remove").alias("gone")).dropna()
    one = one.groupBy("list", "kind", "pattern", "dated").agg(F.max("gone").alias("gone"))
    timeline = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    changes = one.withColumn("before", F.coalesce(F.lag("gone").over(timeline), F.lit(True))).filter("gone <> before")
    return changes.withColumn("until", F.lead("dated").over(timeline)).filter("not gone").select("list", "kind", "pattern", F.col("dated").alias("since"), "until")


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked (at, fetched, ...) joined with the spans (at, since, until, ...) of the same pattern that hold at the fetch time."""
    size = spans.agg(F.sum(F.octet_length("at") + F.octet_length("list") + ROW_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = asked.join(F.broadcast(spans), "at")
    else:
        listed = asked.join(spans.select("at").distinct().hint("shuffle_merge"), "at", "left_semi")
        joined = spread_join(checkpoint(listed), spans, "at")
    return joined.filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))


def lookups(url: Column) -> Column:
    """array of (kind, pattern): the host, the host and every domain above it, and every path prefix up to a slash or the end."""

    def domains(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def prefixes(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    host = host_of(url)
    pair = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    found = F.concat(
        F.array(pair("host")(host)),
        F.transform(F.flatten(F.transform(F.array(F.split(host, r"\.")), domains)), pair("domain")),
        F.transform(F.flatten(F.transform(F.array(F.split(F.regexp_replace(F.concat(host, path_of(url)), "/+$", ""), "/+")), prefixes)), pair("prefix")),
    )
    return F.when(host != "", F.array_distinct(found))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, blocked, n_matches, lists: one row per distinct capture (page_id, url, fetched).

    A capture is blocked if any entry that fits holds at its fetch time (from its date on, until the date of
    its removal). A null or malformed URL, or a null fetch time, matches nothing; a null page_id is kept.
    Other columns are ignored; empty tables give an empty result, an empty list blocks nothing.
    """
    rows = captures.select("page_id", "url", "fetched").distinct()
    key = lambda kind, pattern: F.concat(kind, F.lit(":"), pattern)
    asked = rows.filter("fetched is not null").select("page_id", "url", "fetched", F.explode(F.transform(lookups(F.col("url")), lambda k: key(k["kind"], k["pattern"]))).alias("at"))
    spans = checkpoint(validity(entries).select(key(F.col("kind"), F.col("pattern")).alias("at"), "list", "since", "until"))
    found = as_of(asked, spans).groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    found = found.select(F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.col("fetched").alias("__fetched"), "n_matches", "lists")
    same = rows["page_id"].eqNullSafe(F.col("__page")) & rows["url"].eqNullSafe(F.col("__url")) & rows["fetched"].eqNullSafe(F.col("__fetched"))
    return rows.join(found, same, "left").select(
        "page_id", "url", "fetched", F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists")
    )


def draw(value: Column, first: int = 1) -> Column:
    """A repeatable number below 2^24 from the MD5 of a value."""
    return F.conv(F.substring(F.md5(value.cast("string")), first, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day per row of pages: the table has none, so it's drawn from the id over 1,461 days from 2020-01-01. Null ids draw one day, null URLs stay null, repeated rows stay; other columns are ignored."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (draw(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) % 1461).cast("int"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), day.alias("fetched"))


def lists_of(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own hosts in one scan: every third host is added, most are removed later, some added again; a tenth of host and first path segment; every second parent domain.

    Null and malformed URLs give no entry, repeated ones the same; other columns are ignored; an empty table gives an empty list.
    """
    start = F.lit("2020-01-01").cast("date")
    url = F.col("url").cast("string")
    host, segment = host_of(url), F.regexp_extract(path_of(url), "^/([^/]+)", 1)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    named = lambda kind, name, some: F.struct(F.lit(kind).alias("kind"), name.alias("pattern"), F.lit(some).alias("some"))
    names = F.array(named("host", host, 3), F.when(segment != "", named("prefix", F.concat_ws("/", host, segment), 10)), F.when(parent != "", named("domain", parent, 2)))
    rows = pages.filter(host != "").select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("x")).select("x.*").distinct()
    rows = rows.withColumn("n", draw(F.col("pattern"))).withColumn("k", draw(F.col("pattern"), 7)).filter("n % some = 0")
    steps = F.array(
        F.struct(F.lit("add").alias("action"), (F.col("k") % 700).alias("day")),
        F.when(F.col("k") % 5 < 4, F.struct(F.lit("remove").alias("action"), (F.col("k") % 700 + 1 + F.col("k") % 400).alias("day"))),
        F.when(F.col("k") % 5 < 2, F.struct(F.lit("add").alias("action"), (F.col("k") % 700 + 401 + F.col("k") % 300).alias("day"))),
    )
    rows = rows.select("kind", "pattern", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    return rows.select(F.concat("kind", F.lit("s")).alias("list"), "kind", "pattern", "s.action", F.date_add(start, F.col("s.day").cast("int")).alias("dated"))
