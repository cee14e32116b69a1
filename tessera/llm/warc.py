"""Not-modified revisit records resolved to the full responses they stand for.

A revisit (an answer with status 304) has headers but no content. It is joined as of its
time to the latest earlier full response of the same canonical URL. The answer's
validators must agree with that response: its ETag by weak comparison if it has one, else
its Last-Modified; with neither it is taken on trust. The merged headers are the
response's, except that those a 304 answer may update come from the revisit.

The as-of join sorts by canonical URL and time. Time is cut at approximate quantiles, so
that even a URL with a third of all records is sorted in pieces of ``PIECE_ROWS`` rows or so; the last
response before a piece comes from a table with a row for each URL and piece.

Defined cases: "earlier" means a smaller time; of responses at the same time the one with
the larger record id counts; a null URL matches nothing; repeated records are resolved
one by one; a null time comes before all others and has nothing earlier. Only records of type
``revisit`` are resolved; one whose status is known and not 304 is not, and says
``status``. Only records of type ``response`` whose status is unknown or 200 are resolved
to. Records of other types (request, metadata, warcinfo, null) give no row. Other columns
are not read, so none can clash; headers and URLs may be long, content is not carried; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PIECE_ROWS = 500_000
LEAST_PIECES = 8
#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change what a URL names.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Host in lower case without www and default port, path without closing slashes, then
    the sorted parameters other than tracking ones; no scheme and no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row for each revisit: what it resolves to, how, and the merged headers.

    ``records`` has record_id, url, ts, type, status and headers, a map from lower-case names.
    """
    status, full = F.col("status"), F.col("type") == "response"
    fits = F.coalesce(F.when(full, status == 200).otherwise(status == 304), F.lit(True))
    known = records.filter(F.col("type").isin("response", "revisit"))
    odd = known.filter(~full & ~fits).select("record_id", canonical(F.col("url")).alias("key"), "ts")
    keyed = known.filter(fits).select("record_id", canonical(F.col("url")).alias("key"), "ts", full.alias("full"), "headers")
    rows = keyed.count()
    pieces = max(LEAST_PIECES, rows // PIECE_ROWS + 1)
    cuts = sorted(set(keyed.approxQuantile("ts", [i / pieces for i in range(1, pieces)], 0.01))) if rows else []
    piece = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    response = F.when(F.col("full"), F.struct("record_id", "headers"))
    cut = keyed.filter(F.col("key").isNotNull()).withColumn("piece", F.coalesce(piece, F.lit(0))).withColumn("response", response)
    cut = stage(cut)

    newest = F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id")))
    ends = cut.groupBy("key", "piece").agg(newest.alias("newest"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "piece", F.last("newest", ignorenulls=True).over(earlier).alias("carried")).filter("carried is not null")

    inside = Window.partitionBy("key", "piece").orderBy(F.asc_nulls_first("ts"), "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("near", F.last("response", ignorenulls=True).over(inside)).filter(~F.col("full"))
    met = met.join(stage(carried), ["key", "piece"], "left").withColumn("found", F.coalesce("near", "carried"))

    own, base = F.col("headers"), F.col("found.headers")
    etag, changed = own["etag"], own["last-modified"]
    how = (
        F.when(F.col("found").isNull(), "none")
        .when(etag.isNotNull(), F.when(_opaque(etag) == _opaque(base["etag"]), "etag").otherwise("mismatch"))
        .when(changed.isNotNull(), F.when(changed == base["last-modified"], "last-modified").otherwise("mismatch"))
        .otherwise("trust")
    )
    update = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    unseen = keyed.filter(F.col("key").isNull() & ~F.col("full")).select("record_id", "key", "ts", F.lit("none").alias("how"))
    unseen = unseen.union(odd.withColumn("how", F.lit("status")))
    met = met.select("record_id", "key", "ts", how.alias("how"), F.col("found.record_id").alias("response_id"), merged.alias("headers"))
    met = met.unionByName(unseen.select("record_id", "key", "ts", "how", F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers")))
    good = ~F.col("how").isin("none", "mismatch", "status")
    return met.withColumn("response_id", F.when(good, F.col("response_id"))).withColumn("headers", F.when(good, F.col("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records from a table of pages: of each, a full response and two revisits.

    One revisit comes before the page's own response and knows its Last-Modified only, the
    other comes a while after it and has its ETag; with other pages of the same canonical
    URL between, they meet older or newer versions.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), 1, 16), F.lit('"'))
    p = F.col("page_id")
    small = pages.select("page_id", "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))

    def text(c: Column) -> Column:
        return c.cast("string")

    def headers(**named: Column) -> Column:
        return F.create_map(*[x for k, v in named.items() for x in (F.lit(k.replace("_", "-")), v)])

    late = p * 10 + 5 + 10 * (p % 977)
    kinds = F.array(
        F.struct((p * 3).alias("record_id"), (p * 10).alias("ts"), F.lit("response").alias("type"),
                 headers(cache_control=F.lit("max-age=60"), content_length=F.col("size"), content_type=F.lit("text/html"), date=text(p * 10), etag=F.col("tag"), last_modified=text(p % 500)).alias("headers")),
        F.struct((p * 3 + 1).alias("record_id"), (p * 10 - 5).alias("ts"), F.lit("revisit").alias("type"),
                 headers(content_length=F.lit("0"), date=text(p * 10 - 5), expires=text(p * 10 + 55), last_modified=text(p % 500)).alias("headers")),
        F.struct((p * 3 + 2).alias("record_id"), late.alias("ts"), F.lit("revisit").alias("type"),
                 headers(cache_control=F.lit("max-age=600"), content_length=F.lit("0"), date=text(late), etag=F.concat(F.lit("W/"), F.col("tag"))).alias("headers")),
    )
    status = F.when(F.col("x.type") == "response", 200).otherwise(304)
    return small.select("url", F.explode(kinds).alias("x")).select("x.record_id", "url", "x.ts", "x.type", status.alias("status"), "x.headers")


def digest(resolved: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.select("record_id", F.col("key").alias("canonical_url"), "ts", "how", "response_id", F.array_join(F.array_sort(entries), "; ").alias("merged"))


ORACLE = r"""
with a as (select page_id as p, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag, strlen(coalesce(html, '')) as size,
  regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as bare from pages),
b as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') as host,
  regexp_replace(bare, '^[^/?]*', '') as rest from a),
c as (select *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) as q from b),
k as (select *, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as key from c),
r as (select key, p * 10 as ts, p * 3 as id, p, tag, size from k),
v as (select p * 3 + 1 as record_id, key, p * 10 - 5 as ts, p, tag, 'early' as kind from k
  union all select p * 3 + 2, key, p * 10 + 5 + 10 * (p % 977), p, tag, 'late' from k),
j as (select v.record_id, v.key, v.ts, v.p, v.tag, v.kind, r.id, r.p as rp, r.tag as rtag, r.size, r.ts as rts,
  row_number() over (partition by v.record_id order by r.ts desc nulls last, r.id desc) as n
  from v left join r on v.key = r.key and r.ts < v.ts),
h as (select *, case when id is null then 'none' when kind = 'late' then case when tag = rtag then 'etag' else 'mismatch' end
  else case when p % 500 = rp % 500 then 'last-modified' else 'mismatch' end end as how from j where n = 1)
select record_id, key as canonical_url, ts, how, case when how not in ('none', 'mismatch') then id end as response_id,
  case when how in ('none', 'mismatch') then null
    when kind = 'late' then 'cache-control=max-age=600; content-length=' || size || '; content-type=text/html; date=' || ts || '; etag=W/' || tag || '; last-modified=' || (rp % 500)
    else 'cache-control=max-age=60; content-length=' || size || '; content-type=text/html; date=' || ts || '; etag=' || rtag || '; expires=' || (ts + 60) || '; last-modified=' || (rp % 500) end as merged
from h
"""
