"""Resolution of not-modified (304) captures in web archives.

A revisit record stands for the latest earlier full response of its canonical URL.
The as-of join runs in two levels so that no URL is one task's work: a window within
(URL, time bucket), and a carry of each bucket's last response over the buckets of
the URL, of which there are at most the archive's time span over the bucket width.
Payloads never move: only keys and validators are joined.

A match must agree with the revisit's strongest validator: ETag (weak comparison),
else Last-Modified, else payload digest; a revisit with none is ``unvalidated``.
Header fields that a 304 response may update are merged into the original's.

Defined results: records of another or no kind take no part; a null URL matches nothing (``no_original``); records with a null
time are later than all, so a revisit with a null time stands for its URL's last
response that has one; responses of equal time rank by record_id; a response of the
revisit's own time is not earlier; repeated rows each resolve; null headers are empty;
field names compare without case; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a 304 response carries for the stored response (RFC 9110, section 15.4.5), and Last-Modified.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Query parameters that do not select content.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host without www, m and default ports, path without final slashes, query sorted without tracking; no scheme, no fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:(80|443)?$", ""), r"^(www[0-9]*|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    terms = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda t: (t != "") & ~F.lower(t).rlike(TRACKING))
    query = F.array_join(F.array_sort(terms), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _lower_names(headers: Column) -> Column:
    h = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    names = F.array_distinct(F.transform(F.map_keys(h), lambda k: F.lower(k)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == n)[0]["value"]))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 4096) -> DataFrame:
    """Revisit rows of ``records`` (record_id, kind, url, ts, etag, last_modified, digest, headers) with original_id, verdict and headers."""
    r = records.where(F.col("kind").isin("response", "revisit")).select("record_id", F.col("kind") == "response", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("double"), "etag", "last_modified", "digest", "headers")
    r = r.toDF("record_id", "full", "canonical", "ts", "etag", "last_modified", "digest", "headers").withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    known = r.where("canonical is not null and ts is not null")
    source = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = known.withColumn("near", F.last(F.when(F.col("full"), source), ignorenulls=True).over(inside)).where("not full")
    ends = known.groupBy("canonical", "bucket").agg(F.max_by(F.when(F.col("full"), source), F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end"))
    across = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical", "bucket", F.last("end", ignorenulls=True).over(across).alias("carry")).where("carry is not null")
    found = near.join(carried, ["canonical", "bucket"], "left").withColumn("o", F.coalesce("near", "carry"))
    last = known.where("full").groupBy("canonical").agg(F.max_by(source, F.struct("ts", "record_id")).alias("o"))
    late = r.where("not full and canonical is not null and ts is null").join(last, "canonical", "left")
    lost = r.where("not full and canonical is null").withColumn("o", F.lit(None).cast(found.schema["o"].dataType))
    found = found.select(*r.columns, "o").unionByName(late.select(*r.columns, "o")).unionByName(lost.select(*r.columns, "o"))
    strong = lambda e: F.regexp_replace(e, "^W/", "")
    agree = (
        F.when(F.col("etag").isNotNull(), F.coalesce(strong(F.col("etag")) == strong(F.col("o.etag")), F.lit(False)))
        .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("o.last_modified"), F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("o.digest"), F.lit(False)))
    )
    verdict = F.when(F.col("o").isNull(), "no_original").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("verdict", verdict).withColumn("new", F.map_filter(_lower_names(F.col("headers")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull()))
    merged = F.map_concat(F.map_filter(_lower_names(F.col("o.headers")), lambda k, v: ~F.array_contains(F.map_keys("new"), k)), F.col("new"))
    good = F.col("verdict").isin("resolved", "unvalidated")
    return found.select("record_id", F.col("canonical").alias("canonical_url"), F.when(good, F.col("o.record_id")).alias("original_id"), "verdict", F.when(good, merged).alias("headers"))


def captures_of_pages(pages: DataFrame, delay: int = 500) -> DataFrame:
    """A capture log of a page table: each page is a full response at second page_id, and is asked for again ``delay`` seconds later, answered by a 304."""
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("digest"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("digest")), F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("Date"), (F.col("page_id") + delay).cast("string"))
    none = F.lit(None).cast("string")
    full = base.select((2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), F.col("digest").alias("etag"), none.alias("last_modified"), "digest", first.alias("headers"))
    return full.unionByName(base.select((2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") + delay).alias("ts"), F.concat(F.lit("W/"), F.col("digest")).alias("etag"), none.alias("last_modified"), none.alias("digest"), again.alias("headers")))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, url,
  regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@|:(80|443)?$', '', 'g'), '^(www[0-9]*|m)\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda t: t <> '' AND NOT regexp_full_match(lower(t), '(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=.*)?'))), '&') AS query FROM pages),
c AS (SELECT page_id, digest, size, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM u),
j AS (SELECT r.page_id, r.canonical, r.digest, o.page_id AS o_id, o.digest AS o_digest, o.size, row_number() OVER (PARTITION BY r.page_id ORDER BY o.page_id DESC) AS k FROM c r LEFT JOIN c o ON o.canonical = r.canonical AND o.page_id < r.page_id + 500)
SELECT (2 * page_id + 1)::BIGINT AS record_id, canonical AS canonical_url,
  CASE WHEN digest = o_digest THEN 2 * o_id END::BIGINT AS original_id,
  CASE WHEN o_id IS NULL THEN 'no_original' WHEN digest = o_digest THEN 'resolved' ELSE 'validator_mismatch' END AS verdict,
  CASE WHEN digest = o_digest THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 500) || chr(10) || 'etag: W/' || digest END AS headers
FROM j WHERE k = 1
"""
