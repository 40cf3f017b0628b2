"""WARC: resolving not-modified revisit records against earlier full responses.

A revisit record stands for a body that was not stored again. It is joined as of its date to the
latest earlier full response of the same canonical URL; its validators must agree with that
response; the headers a 304 answer may update replace those of the response.

The join is one range partitioning by (URL, date) and a running "last response" in each piece;
what reaches a piece from earlier ones is one row per piece. So a URL with a third of all
rows is spread over many tasks, and no pairs are made. Bodies never move.

Defined results: earlier means a smaller date; of several responses with the latest date the one with the
largest record id counts; equal rows give equal results; null URLs and null dates find nothing and are found by
nobody; null headers are empty; an empty table gives no rows; other columns are left out. Header
names are lower-cased, and of a repeated name the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fenestra.llm.common import partitions
from fenestra.session import stage

# Header fields that a 304 answer may carry to update a stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without user and default port, path or ``/``, sorted query, no fragment."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), "^.*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    pairs = F.filter(F.split(F.regexp_replace(part(4), r"^\?", ""), "&"), lambda p: p != "")
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(url.rlike(_URL), F.concat(scheme, F.lit("://"), host, path,
                                            F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def folded_headers(headers: Column) -> Column:
    """Lower-case names; of a repeated name the last value stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.reverse(F.transform(entries, lambda e: e["key"]))
    last = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == F.size(names) - i)
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _last_response(records: DataFrame) -> DataFrame:
    """Add ``found``: the last response before each row in (url_key, date) order."""
    # at one date revisits come first: a response of the same date is not earlier
    order = ["url_key", "date", "is_response", "record_id"]
    ranged = records.repartitionByRange(partitions(records), *order)
    # written, so that a piece stays the same when its task is run again
    pieces = stage(ranged.withColumn("_piece", F.spark_partition_id()), "records")
    own = F.when(F.col("is_response"), F.struct("record_id", "date", "headers", "digest"))
    before = Window.partitionBy("url_key", "_piece").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    inside = pieces.withColumn("_inside", F.last(own, ignorenulls=True).over(before))
    # rows are in order over all pieces: only the first URL of a piece can have rows in earlier ones, as their last URL
    last = F.struct("url_key", "record_id", "date", "headers", "digest")
    summary = pieces.groupBy("_piece").agg(
        F.min("url_key").alias("first"), F.max("url_key").alias("last"),
        F.max_by(last, F.when(F.col("is_response"), F.struct("url_key", "date", "record_id"))).alias("_r"))
    reaches = (F.col("_r.url_key") == F.col("last")) & F.col("_r.record_id").isNotNull()
    ends = summary.select(F.col("last").alias("url_key"), (F.col("_piece") * 2 + 1).alias("at"), F.when(reaches, F.struct(
        "_r.record_id", "_r.date", "_r.headers", "_r.digest")).alias("_end"))
    none = F.lit(None).cast(ends.schema["_end"].dataType).alias("_end")
    starts = summary.select(F.col("first").alias("url_key"), (F.col("_piece") * 2).alias("at"), none)
    earlier = Window.partitionBy("url_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.unionByName(ends).withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where(
        "at % 2 = 0 and _carried is not null").select("url_key", (F.col("at") / 2).cast("int").alias("_piece"), "_carried")
    return inside.where("not is_response").join(carried, ["url_key", "_piece"], "left").withColumn(
        "found", F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_piece")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record: status, the response it stands for, and the merged headers.

    ``records``: record_id, url, date, kind (``response`` or ``revisit``), status, headers
    (map), digest. Only responses with status 200 are full ones. Status of a revisit:
    ``resolved``, ``mismatch`` (validators differ), ``unvalidated`` (nothing to compare) or
    ``orphan`` (no earlier response).
    """
    prepared = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "date", (F.col("kind") == "response").alias("is_response"),
        folded_headers(F.col("headers")).alias("headers"), "digest", F.col("kind").alias("kind"), "status")
    used = prepared.where("kind = 'revisit' or (kind = 'response' and status = 200 and date is not null and url_key is not null)")
    usable = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    joined = _last_response(used.where(usable).drop("kind", "status"))
    lost = used.where(~usable).drop("kind", "status").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    rows = joined.unionByName(lost)

    mine, theirs = F.col("headers"), F.col("found.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    by_digest = F.when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest"))
    since = "last-modified"
    agrees = F.when(mine["etag"].isNotNull() & theirs["etag"].isNotNull(), tag(mine) == tag(theirs)).when(
        mine[since].isNotNull() & theirs[since].isNotNull(), mine[since] == theirs[since]).otherwise(by_digest)
    status = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unvalidated").when(
        agrees, "resolved").otherwise("mismatch")
    updates = F.map_filter(mine, lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    return rows.select("record_id", "url_key", "date", status.alias("status"), "found", F.map_concat(kept, updates).alias("_m")).select(
        "record_id", "url_key", "date", "status", F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("refers_to"),
        F.when(F.col("status") == "resolved", F.col("found.date")).alias("refers_to_date"),
        F.when(F.col("status") == "resolved", F.col("_m")).alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as ``name: value`` lines, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)),
                                    lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records made from ``pages``: a response for each page, and a later revisit of its URL.

    Some URLs have a further response of other content, before the page's or after the revisit. Some revisits carry a weak
    tag, a changed tag, or a date only; every 13th response is an error page; URLs of revisits are written in another way.
    """
    k = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), (k % 24).cast("string"))
    base = pages.select(k, "url", etag.alias("etag"), F.octet_length("html").alias("bytes"), F.md5("html").alias("digest"))

    def responses(pages: DataFrame, record_id: Column, date: Column, status: Column, etag: Column, size: Column, digest: Column) -> DataFrame:
        sent = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), changed,
                            F.lit("Content-Length"), size.cast("string"), F.lit("Date"), date.cast("string"), F.lit("Cache-Control"), F.lit("no-cache"))
        return pages.select(record_id.alias("record_id"), "url", date.alias("date"), F.lit("response").alias("kind"),
                            status.cast("int").alias("status"), sent.alias("headers"), digest.alias("digest"))

    none = F.lit(None).cast("string")
    response = responses(base, 2 * k, k * 60, F.when(k % 13 == 5, 503).otherwise(200), F.col("etag"), F.col("bytes"), F.col("digest"))
    for remainder, moved, tag in ((0, -100, '"old"'), (1, 9010, '"new"')):
        response = response.unionByName(responses(base.where(k % 3 == remainder), -k - 1, k * 60 + moved, F.lit(200), F.lit(tag), F.lit(7), none))
    written = F.regexp_replace(F.concat(F.col("url"), F.lit("#again")), "^http:", "HTTP:")
    tagged = F.when(k % 5 == 0, F.concat(F.lit("W/"), F.col("etag"))).when(k % 11 == 1, '"other"').when(
        k % 6 != 1, F.col("etag"))
    sent = F.create_map(F.lit("ETag"), tagged, F.lit("Last-Modified"), changed, F.lit("Date"), (k * 60 + 5000).cast("string"),
                        F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"),
                        F.lit("Expires"), F.concat(F.lit("in "), (k % 7).cast("string")))
    revisit = base.select((2 * k + 1).alias("record_id"), written.alias("url"), (k * 60 + 5000).alias("date"), F.lit("revisit").alias("kind"),
                          F.lit(304).alias("status"), F.map_filter(sent, lambda n, v: v.isNotNull()).alias("headers"),
                          F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)
