"""WARC revisits: which stored response a "not modified" answer stands for.

A revisit (status 304) stands for the latest earlier full response (status 200)
of the same canonical URL.  The validators say whether it really does: equal
entity tags (weak or not: "W/" does not count), or without tags equal modification
dates.  The headers of the resolved record are those of the response, overridden
by those a 304 may renew; names are compared without regard to case, and no
headers (null) are like none.

The as-of join is a union of both kinds in time order.  To keep a hot URL out of
one task, time is cut into ranges of about ``RANGE_ROWS`` records: inside a
(URL, range) a window finds the latest response, and the latest response of the
ranges before is carried in from one row per (URL, range).

A null URL matches nothing.  Records of equal time: a response at the very
second of a revisit is not earlier; of two responses at one second the larger
id counts as later.  Repeated records each give their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Records of a time range, about; and ranges at most.
RANGE_ROWS, MOST_RANGES = 200_000, 1000

RECORD = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """The address without what does not tell documents apart: scheme, "www.",
    fragment, default port, last slash, campaign parameters and their order."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    kept = F.sort_array(F.filter(asked, lambda x: (x != "") & ~x.startswith("utm_")))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def time_ranges(records: DataFrame) -> Column:
    """Number of the time range of a record; bounds from approximate quantiles."""
    rows = records.count()
    ranges = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    if ranges <= 1:
        return F.lit(0)
    shares = [k / ranges for k in range(1, ranges)]
    bounds = records.agg(F.percentile_approx("ts", shares)).first()[0]
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("ts")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the response it stands for.

    ``outcome``: ``resolved``, ``changed`` (validators differ), ``unchecked`` (no
    validator to compare) or ``missing`` (no earlier response).  Only resolved
    and unchecked rows carry a digest and merged headers.
    """
    placed = records.where("status in (200, 304)").select(
        "*", canonical_url(F.col("url")).alias("canonical"), time_ranges(records).alias("span")
    )
    full = F.col("status") == 200
    response = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    placed = placed.withColumn("response", F.when(full, response))

    latest = placed.where(full & F.col("canonical").isNotNull()).groupBy("canonical", "span").agg(
        F.max_by("response", F.struct("ts", "record_id")).alias("last")
    )
    # One row per URL and range with a response; it holds from the next range on,
    # until the next such row.
    in_order = Window.partitionBy("canonical").orderBy("span")
    carried = latest.select(
        F.col("canonical").alias("c_url"),
        F.col("span").alias("c_from"),
        F.coalesce(F.lead("span").over(in_order), F.lit(MOST_RANGES)).alias("c_to"),
        F.col("last").alias("carried"),
    )
    inside = (
        Window.partitionBy("canonical", "span")
        .orderBy("ts", full.cast("int"), "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    revisits = placed.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where(
        ~full
    )
    # Revisits that have their response in their own range need no carried one.
    joined = revisits.join(
        carried,
        F.col("near").isNull()
        & (F.col("canonical") == F.col("c_url"))
        & (F.col("span") > F.col("c_from"))
        & (F.col("span") <= F.col("c_to")),
        "left",
    ).withColumn("found", F.when(F.col("canonical").isNotNull(), F.coalesce("near", "carried")))
    strong = lambda tag: F.regexp_replace(tag, "^[Ww]/", "")
    same_tag = strong(F.col("etag")) == strong(F.col("found.etag"))
    same_date = F.col("last_modified") == F.col("found.last_modified")
    same = F.coalesce(same_tag, same_date)
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(same.isNull(), "unchecked")
        .otherwise(F.when(same, "resolved").otherwise("changed"))
    )
    none = F.create_map().cast("map<string,string>")
    renewed = F.map_filter(F.coalesce("headers", none), lambda name, _: F.lower(name).isin(*RENEWED))
    names = F.transform(F.map_keys(renewed), F.lower)
    stored = F.map_filter(
        F.coalesce("found.headers", none), lambda name, _: ~F.array_contains(names, F.lower(name))
    )
    valid = F.col("outcome").isin("resolved", "unchecked")
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "canonical",
        "ts",
        "outcome",
        F.col("found.record_id").alias("refers_to"),
        F.col("found.ts").alias("refers_to_ts"),
        F.when(valid, F.col("found.digest")).alias("digest"),
        F.when(valid, F.map_concat(stored, renewed)).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of stored pages: each page was answered in full once, a
    minute after the page before, and not modified some hours later.  Every fifth
    later answer carries an old entity tag, every seventh none."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    first = F.lit(1_700_000_000) + F.col("page_id") * 60
    date = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    responses = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        first.alias("ts"),
        F.lit(200).alias("status"),
        digest.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        digest.alias("digest"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"),
            F.lit("date"), date(first),
            F.lit("etag"), digest,
        ).alias("headers"),
    )
    later = first + F.col("page_id") % 7 * 3600 + 30
    tag = F.when(F.col("page_id") % 5 == 0, F.lit("old")).when(F.col("page_id") % 7 != 0, digest)
    revisits = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        later.alias("ts"),
        F.lit(304).alias("status"),
        tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(
            F.lit("content-length"), F.lit("0"), F.lit("date"), date(later)
        ).alias("headers"),
    )
    return responses.unionAll(revisits)


def resolve_pages(pages: DataFrame) -> DataFrame:
    """Resolved revisits of the crawl log of the pages; headers as text, by name."""
    headers = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
        ),
        "\n",
    )
    return resolve_revisits(crawl_records(pages)).withColumn("headers", headers)
