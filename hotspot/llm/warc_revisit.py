"""Not-modified revisits of a web archive, resolved by an as-of join. DataFrame functions only.

A revisit takes the latest earlier full response of its canonical URL, if the validators
agree; the stored headers are updated with those that a 304 response may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspot.llm.common import shuffle_partitions, stored

#: Records in a slice, about; a log has as many slices as that takes, or as many as a shuffle has partitions.
SLICE = 200_000
# fixed values: fields that a 304 response does not change in the stored one
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# fixed values: parameters that name a visit, not a page
VISIT_PARAMETERS = r"^(utm_[a-z]+|ref|fbclid|gclid|jsessionid|sessionid|phpsessid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a final slash, parameters sorted
    without those of a visit; no scheme, no fragment. Null and urls without ``://`` give null."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^[^:]*://([^#]*)", 1), r"^[^/?@]*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\d*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(VISIT_PARAMETERS)))
    text = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(url.contains("://"), text)


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then repeat, the values joined with a comma."""
    e = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(e, lambda x: F.lower(x["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_join(F.transform(F.filter(e, lambda x: F.lower(x["key"]) == n), lambda x: x["value"]), ", ").alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated with the permitted ones of the not-modified response."""
    fields = F.lower(F.coalesce(fresh["connection"], F.lit("")))
    listed = F.transform(F.split(fields, ","), lambda x: F.trim(x))
    new = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_FIELDS) & ~F.array_contains(listed, k) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)


def same_validators(stored: Column, fresh: Column) -> Column:
    """Entity tags agree (weakly compared) or, without one in the revisit, the dates of last change do;
    a revisit without either agrees with a response that has none."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    by_tag, by_date = tag(stored) == tag(fresh), stored["last-modified"] == fresh["last-modified"]
    none = stored["etag"].isNull() & stored["last-modified"].isNull()
    return F.coalesce(F.when(fresh["etag"].isNotNull(), by_tag).when(fresh["last-modified"].isNotNull(), by_date).otherwise(none), F.lit(False))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Every revisit of ``records(record_id, url, ts, kind, status, headers, digest)`` with what it stands for.

    ``kind`` is ``response`` or ``revisit``; ``ts`` a timestamp or number. Returns ``(record_id, url,
    canonical, ts, outcome, source_id, source_ts, digest, headers)``; outcome is ``resolved``,
    ``no earlier response`` or ``validators differ`` (then digest and headers are those of the revisit
    itself, and the latest earlier response is still named). Earlier is less in (ts, kind, record_id),
    responses before revisits of the same time. Full responses have status 200, 203 or none given. A
    null url, url without ``://`` or null ts has no earlier response; null headers are none; records
    that repeat an id are resolved each for itself; an empty table gives an empty result, and further
    columns are ignored.

    All records are cut, in the order of URL, time, kind and id, into slices of about ``slice_rows`` each
    (Spark's sampled range partitions; what is equal in all of these is parted at random). A burst or an early
    outlier thus moves the cuts, and records of one second are cut as well. The last response of every
    slice is carried to the URL's next ones, so that no URL meets in one task whatever its share.
    Payloads are not moved: ``with_payload`` joins them to the result.
    """
    status = F.coalesce(F.col("status").cast("int"), F.lit(200))
    r = records.select("record_id", "url", "ts", "kind", "headers", "digest", (status.isin(200, 203) & (F.col("kind") == "response")).alias("full"))
    r = r.where(F.col("full") | (F.col("kind") == "revisit")).withColumns({"canonical": canonical_url(F.col("url")), "at": F.col("ts").cast("double")}).drop("kind")
    can = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    known = in_slices(r.where(can), slice_rows)
    lost = r.where(~can & ~F.col("full")).withColumn("headers", lower_names(F.col("headers")))
    full = F.when(F.col("full"), F.struct("record_id", "ts", "digest", "headers"))
    in_slice = Window.partitionBy("canonical", "slice").orderBy("at", "later", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    lasts = known.where("full").groupBy("canonical", "slice").agg(F.max_by(F.struct("record_id", "ts", "digest", "headers"), F.struct(F.col("at"), F.col("record_id"))).alias("tail"))
    # slices of a URL: far fewer than its records; only a URL that is cut has something to carry
    slices = known.select("canonical", "slice").distinct().join(lasts, ["canonical", "slice"], "left")
    carried = slices.select("canonical", "slice", F.last("tail", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")).where("carried is not null")
    known = known.withColumn("own", F.last(full, ignorenulls=True).over(in_slice))
    found = known.where("not full").join(carried, ["canonical", "slice"], "left").withColumn("src", F.coalesce("own", "carried")).select("record_id", "url", "canonical", "ts", "headers", "digest", "src")
    lost = lost.select("record_id", "url", "canonical", "ts", "headers", "digest", F.lit(None).cast(found.schema["src"].dataType).alias("src"))
    out = found.unionByName(lost)
    agree = same_validators(F.col("src.headers"), F.col("headers"))
    outcome = F.when(F.col("src").isNull(), "no earlier response").when(agree, "resolved").otherwise("validators differ")
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "url", "canonical", "ts", "outcome", F.col("src.record_id").alias("source_id"), F.col("src.ts").alias("source_ts"),
        F.when(good, F.col("src.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(good, merged_headers(F.col("src.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def in_slices(known: DataFrame, slice_rows: int) -> DataFrame:
    """Records with their ``slice``: a slice holds about ``slice_rows`` successive ones in the order of URL,
    time, kind and id. Written once: the cuts are sampled, and all that follows must see the same."""
    parts = max(shuffle_partitions(known.sparkSession), -(-known.count() // slice_rows))
    order = ["canonical", "at", "later", "record_id", "chance"]
    known = known.withColumns({"later": (~F.col("full")).cast("int"), "chance": F.rand(7)})
    known = known.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id())
    return stored(known.drop("chance").withColumn("headers", lower_names(F.col("headers"))), "slices")


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of their source: ``payloads(record_id, payload)``."""
    p = payloads.select(F.col("record_id").alias("source_id"), "payload")
    return resolved.where(F.col("outcome") == "resolved").join(p, "source_id")


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages(page_id, url, html)``, without payloads.

    Each page gives a full response and a later revisit of its URL under another scheme and with a
    visit parameter; one revisit in eight has another entity tag, and one in eight only a date. It
    also gives a record of its host's front page: a full response for one page in four by hash, else
    a revisit whose tag changes every ten days.
    """
    h = F.md5(F.col("page_id").cast("string"))
    part = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"), (part(1, 6) % 2592000 + 1700000000).alias("t"), (part(7, 4) % 86400 + 1).alias("gap"), (part(11, 2) % 8).alias("form"), (part(13, 2) % 4).alias("root"))
    text = lambda c: c.cast("string")
    m = lambda *kv: F.map_filter(F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv)), lambda k, v: v.isNotNull())
    tag = F.substring("digest", 1, 16)
    changed = F.concat(F.lit("x"), F.substring("digest", 2, 15))
    full = p.select((F.col("page_id") * 4).alias("record_id"), "url", F.col("t").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), m("ETag", tag, "Last-Modified", text(F.col("t")), "Content-Length", F.col("size"), "Date", text(F.col("t"))).alias("headers"), "digest")
    later = F.col("t") + F.col("gap")
    other = F.concat(F.lit("HTTP://"), F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]*://", ""), "#.*$", ""), F.when(F.col("url").contains("?"), "&utm_medium=again").otherwise("?utm_medium=again"))
    their_tag = F.when(F.col("form") == 0, changed).when(F.col("form") != 1, F.concat(F.lit("W/"), tag))
    again = p.select((F.col("page_id") * 4 + 1).alias("record_id"), other.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), m("ETag", their_tag, "Last-Modified", F.when(F.col("form") == 1, text(F.col("t"))), "Content-Length", "0", "Date", text(later), "Cache-Control", "max-age=60").alias("headers"), F.lit(None).cast("string").alias("digest"))
    front = F.regexp_extract("url", "^[a-zA-Z]*://[^/?#]*", 0)
    era = F.concat(F.lit("era"), text(F.floor(F.col("t") / 864000)))
    is_full = F.col("root") == 0
    root = p.select((F.col("page_id") * 4 + 2).alias("record_id"), F.concat(front, F.lit("/")).alias("url"), F.col("t").alias("ts"), F.when(is_full, "response").otherwise("revisit").alias("kind"), F.when(is_full, 200).otherwise(304).alias("status"), m("ETag", era, "Last-Modified", F.lit(None).cast("string"), "Content-Length", F.when(is_full, "512").otherwise("0"), "Date", text(F.col("t"))).alias("headers"), F.when(is_full, F.md5(era)).alias("digest"))
    return full.unionByName(again).unionByName(root)


ORACLE_SQL = r"""
WITH h AS (SELECT page_id, url, md5(page_id::VARCHAR) AS h, md5(coalesce(html, '')) AS digest, length(coalesce(html, ''))::VARCHAR AS size FROM pages),
p AS (SELECT page_id, url, digest, size, ('0x' || substr(h, 1, 6))::BIGINT % 2592000 + 1700000000 AS t, ('0x' || substr(h, 7, 4))::BIGINT % 86400 + 1 AS gap,
             ('0x' || substr(h, 11, 2))::BIGINT % 8 AS form, ('0x' || substr(h, 13, 2))::BIGINT % 4 AS root FROM h),
r AS (
  SELECT page_id * 4 AS record_id, url, t AS ts, TRUE AS is_full, substr(digest, 1, 16) AS etag, t::VARCHAR AS lm, size AS cl, t::VARCHAR AS dt, NULL AS cc, digest FROM p
  UNION ALL
  SELECT page_id * 4 + 1, 'HTTP://' || regexp_replace(regexp_replace(url, '^[a-zA-Z]*://', ''), '#.*$', '') || CASE WHEN contains(url, '?') THEN '&utm_medium=again' ELSE '?utm_medium=again' END,
         t + gap, FALSE, CASE form WHEN 0 THEN 'x' || substr(digest, 2, 15) WHEN 1 THEN NULL ELSE substr(digest, 1, 16) END, CASE WHEN form = 1 THEN t::VARCHAR END, '0', (t + gap)::VARCHAR, 'max-age=60', NULL FROM p
  UNION ALL
  SELECT page_id * 4 + 2, regexp_extract(url, '^[a-zA-Z]*://[^/?#]*') || '/', t, root = 0, 'era' || (t // 864000)::VARCHAR, NULL, CASE WHEN root = 0 THEN '512' ELSE '0' END, t::VARCHAR, NULL,
         CASE WHEN root = 0 THEN md5('era' || (t // 864000)::VARCHAR) END FROM p),
u AS (SELECT *, regexp_extract(url, '^[^:]*://([^#]*)', 1) AS rest FROM r),
v AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\d*\.|:(80|443)$', '', 'g') AS host,
             regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|jsessionid|sessionid|phpsessid)(=|$)'))) AS q FROM u),
c AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM v),
w AS (SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'ts': ts, 'etag': etag, 'lm': lm, 'cl': cl, 'digest': digest} END IGNORE NULLS)
               OVER (PARTITION BY canonical ORDER BY ts, CASE WHEN is_full THEN 0 ELSE 1 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM c),
o AS (SELECT *, CASE WHEN src IS NULL THEN 'no earlier response'
                     WHEN CASE WHEN etag IS NOT NULL THEN coalesce(etag = src.etag, FALSE) WHEN lm IS NOT NULL THEN coalesce(lm = src.lm, FALSE) ELSE src.etag IS NULL AND src.lm IS NULL END THEN 'resolved'
                     ELSE 'validators differ' END AS outcome FROM w WHERE NOT is_full)
SELECT record_id, canonical, ts, outcome, src.id AS source_id, src.ts AS source_ts, CASE WHEN outcome = 'resolved' THEN src.digest ELSE digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN src.cl ELSE cl END AS content_length, dt AS date_field, cc AS cache_control
FROM o
"""
