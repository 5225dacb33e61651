"""WARC: not-modified revisits resolved by an as-of join.

A revisit record (a 304 answer) has no payload of its own: its page is that of the latest earlier full response of
the same canonical URL, if the validators agree. The merged record has the response's payload headers and
those headers of the revisit that a 304 may carry and renew (RFC 9110, 15.4.5).

The join is of two levels, so a URL with very many captures is no single task: within buckets of time by a
window, and between buckets by the last response of each, of which there is one row per URL and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by RFC 9110: what a 304 answer may carry.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: scheme, fragment, user, default port, leading www. or m. and a last slash go, the host is
    lower-cased, tracking parameters go and the others are sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^.*@", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    asked = F.array_join(F.array_sort(query), "&")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))


def resolve_revisits(responses: DataFrame, revisits: DataFrame, bucket: int = 4096) -> DataFrame:
    """(record_id, canonical, ts, response_id, response_ts, status, headers) of each revisit.

    Both tables have record_id, url, ts, etag, last_modified and headers (a map of lower-case names). `status`
    is no_earlier_response, validator_mismatch or resolved; validators agree if the entity tags are equal
    (weak marks aside), or, where either has none, the dates of last modification. Only resolved rows have
    response_id, response_ts and the merged headers. A response at the revisit's own time isn't earlier; of
    responses of one time the one of the largest record_id counts. Rows of a null URL or time have no earlier
    response; repeated revisits are resolved each; other columns are ignored; empty tables give no rows, or
    no_earlier_response for every revisit.
    """
    fields = ["record_id", "url", "ts", "etag", "last_modified", "headers"]
    tagged = lambda df, kind: df.select(*fields).withColumns({"canonical": canonical_url(F.col("url")), "kind": F.lit(kind)}).withColumn("bucket", F.floor(F.col("ts") / bucket))
    full = tagged(responses, 1).where("canonical is not null and ts is not null")
    packed = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    both = full.withColumn("response", packed).unionByName(tagged(revisits, 0).withColumn("response", F.lit(None).cast(full.select(packed.alias("x")).schema["x"].dataType)))
    before = Window.partitionBy("canonical", "bucket").orderBy("ts", "kind", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = both.withColumn("near", F.last("response", True).over(before)).where("kind = 0")
    # the last of each bucket; struct order is by time, then record; headers don't compare, so they follow after
    last = full.groupBy("canonical", "bucket").agg(F.max_by(packed, F.struct("ts", "record_id")).alias("response"))
    marks = last.unionByName(own.where("near is null and canonical is not null and ts is not null").select("canonical", "bucket").distinct().withColumn("response", F.lit(None).cast(last.schema["response"].dataType)))
    marks = marks.groupBy("canonical", "bucket").agg(F.first("response", True).alias("response"))
    carry = marks.withColumn("far", F.last("response", True).over(Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("canonical", "bucket", "far")
    joined = own.join(carry, ["canonical", "bucket"], "left").withColumn("found", F.when(F.col("ts").isNotNull(), F.coalesce("near", "far")))
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    agree = F.when(tags, plain(F.col("etag")) == plain(F.col("found.etag"))).otherwise(F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("found.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(renewed, k))
    good = F.col("status") == "resolved"
    out = joined.withColumn("status", status)
    return out.select(
        "record_id", "canonical", "ts", F.when(good, F.col("found.record_id")).alias("response_id"), F.when(good, F.col("found.ts")).alias("response_ts"), "status", F.when(good, F.map_concat(kept, renewed)).alias("headers")
    )


#: In the query over pages, a page is fetched at twice its id and revisited after this many further ids.
REVISIT_AFTER = 400


def page_captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row of pages(page_id, url, html) as a full response, and as a later revisit by its entity tag."""
    etag = F.md5(F.coalesce("html", F.lit("")))
    ts = 2 * F.col("page_id")
    names = lambda **x: F.create_map(*(v for k, c in x.items() for v in (F.lit(k.replace("_", "-")), c.cast("string"))))
    base = pages.select("page_id", "url", etag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).alias("size"), F.lit(None).cast("string").alias("last_modified"))
    responses = base.select(F.col("page_id").alias("record_id"), "url", ts.alias("ts"), "etag", "last_modified", names(content_type=F.lit("text/html"), content_length=F.col("size"), date=ts, etag=F.col("etag")).alias("headers"))
    later = ts + 2 * REVISIT_AFTER + 1
    revisits = base.select(F.col("page_id").alias("record_id"), "url", later.alias("ts"), "etag", "last_modified", names(date=later, cache_control=F.lit("max-age=60"), content_length=F.lit(0), x_cache=F.lit("HIT")).alias("headers"))
    return responses, revisits


ORACLE_SQL = rf"""
with bare as (
  select page_id, coalesce(html, '') as body, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as u from pages
), parts as (
  select page_id, body, u, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))), '&') as asked
  from bare
), captures as (
  select page_id, 2 * page_id as ts, md5(body) as etag, length(body) as size,
    regexp_replace(host, '^(www|m)\.', '') || path || case when asked <> '' then '?' || asked else '' end as canonical from parts
), revisits as (select page_id, ts + {2 * REVISIT_AFTER + 1} as ts, etag, canonical from captures)
select r.page_id, r.canonical, r.ts as revisit_ts,
  case when s.etag = r.etag then s.page_id end as response_id, case when s.etag = r.etag then s.ts end as response_ts,
  case when s.page_id is null then 'no_earlier_response' when s.etag = r.etag then 'resolved' else 'validator_mismatch' end as status,
  case when s.etag = r.etag then 'cache-control=max-age=60; content-length=' || s.size || '; content-type=text/html; date=' || r.ts || '; etag=' || s.etag end as headers
from revisits r asof left join captures s on r.canonical = s.canonical and r.ts > s.ts
"""
