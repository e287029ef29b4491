"""Not-modified revisits in web archives: an as-of join by canonical URL to the latest earlier full response.

A revisit record (status 304) has no payload of its own.  It resolves to the latest full response of the same canonical URL
before it, if their validators agree: entity tags by weak comparison, else the modification dates, else the payload digests.  The
headers that a 304 may update replace those of the response; all others stay.

The join is made of DataFrame functions on narrow rows, without payloads.  Time is cut into buckets, so that a URL with a third of all
records is spread over many tasks: a window finds the latest response within (URL, bucket), one row for each (URL, bucket) carries
the last response over to later buckets, and only revisits without a response in their own bucket are joined to it.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import table

BUCKETS = 256
#: Header fields that a 304 response updates.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't name another resource.
TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid)="
RECORD = "record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers"


def canonical(url: Column) -> Column:
    """Host (lower case, without www. and default port), path without a trailing slash, and the sorted query without tracking parameters;
    scheme and fragment don't count.  What is no absolute URL is only trimmed."""
    u = F.trim(url)
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda k: F.regexp_extract(u, shape, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), F.lit("^www[.]"), F.lit("")), F.lit(":(80|443)$"), F.lit(""))
    path = F.regexp_replace(part(2), F.lit("/+$"), F.lit(""))
    pairs = F.array_sort(F.filter(F.split(F.substr(part(3), F.lit(2)), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(F.regexp_like(u, F.lit(shape)), F.concat(host, path, query)).otherwise(u)


def _agree(own: Column, other: Column) -> Column:
    """Whether the validators agree; null if none can be compared."""
    weak = lambda tag: F.regexp_replace(tag, F.lit("^W/"), F.lit(""))
    return F.coalesce(weak(own["etag"]) == weak(other["etag"]), own["last_modified"] == other["last_modified"], own["digest"] == other["digest"])


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with the permitted ones of the revisit; names in lower case."""
    empty = F.create_map().cast("map<string,string>")
    low = lambda m: F.map_from_entries(F.array_sort(F.map_entries(F.transform_keys(F.coalesce(m, empty), lambda k, _: F.lower(k)))))
    new = F.map_filter(low(revisit), lambda k, _: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(low(response), lambda k, _: ~F.map_contains_key(new, k)), new)


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """record_id, canonical_url, target_id, state, headers of each revisit in ``records`` (record_id, url, ts, kind, etag, last_modified,
    digest, headers; kind is response or revisit, ts a long).

    state: ``resolved``; ``mismatch`` (the validators of the latest earlier response differ); ``unverified`` (nothing to compare: it is
    resolved all the same); ``orphan`` (no earlier response).  target_id and headers are the response's for resolved and unverified ones and
    null otherwise.  Earlier is by ts, then record_id, then responses before revisits; records without url, ts or a known kind take no part.
    Repeated revisits each have a row.  An empty table gives an empty result; other columns are not read.
    """
    rows = records.select(*RECORD).withColumn("canon", canonical(F.col("url"))).where("canon IS NOT NULL AND ts IS NOT NULL AND kind IN ('response', 'revisit')")
    span = rows.agg(F.min("ts"), F.max("ts")).first()
    low, width = span[0] or 0, max(1, ((span[1] or 0) - (span[0] or 0)) // buckets + 1)
    order = F.struct("ts", "record_id", (F.col("kind") == "revisit").alias("late"))
    own = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    rows = rows.select("canon", F.floor((F.col("ts") - low) / width).alias("bucket"), order.alias("o"), "kind", own.alias("own"))
    response = F.when(F.col("kind") == "response", F.col("own"))
    here = Window.partitionBy("canon", "bucket").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("prior", F.last(response, ignorenulls=True).over(here)).where("kind = 'revisit'")
    ends = rows.where("kind = 'response'").groupBy("canon", "bucket").agg(F.max_by("own", "o").alias("carry"))
    # the response that each bucket with revisits inherits: over at most `buckets` rows for a URL
    waiting = within.where("prior IS NULL").select("canon", "bucket").distinct()
    marks = ends.select("canon", "bucket", "carry").unionByName(waiting.withColumn("carry", F.lit(None).cast(ends.schema["carry"].dataType)))
    marks = marks.groupBy("canon", "bucket").agg(F.max_by("carry", F.col("carry").isNotNull().cast("int")).alias("carry"))
    before = Window.partitionBy("canon").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("canon", "bucket", F.last("carry", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL")
    joined = within.join(carried, ["canon", "bucket"], "left").withColumn("target", F.coalesce("prior", "carried"))
    agree = _agree(F.col("own"), F.col("target"))
    state = F.when(F.col("target").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    good = F.col("state").isin("resolved", "unverified")
    return joined.withColumn("state", state).select(
        F.col("own.record_id").alias("record_id"),
        F.col("canon").alias("canonical_url"),
        F.when(good, F.col("target.record_id")).alias("target_id"),
        "state",
        F.when(good, merged_headers(F.col("target.headers"), F.col("own.headers"))).alias("headers"),
    )


def payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The resolved revisits with the payload of their response (``records``: record_id, payload)."""
    own = records.select(F.col("record_id").alias("target_id"), "payload")
    return resolved.where("target_id IS NOT NULL").join(own, "target_id")


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzip-compressed member by member: named fields (lower case), block."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BufferedReader(io.BytesIO(data))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields: dict[str, str] = {}
        while (head := stream.readline().strip(b"\r\n")) != b"":
            name, _, value = head.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield {"fields": fields, "block": stream.read(int(fields.get("content-length", "0")))}


def write_record(fields: dict[str, str], block: bytes) -> bytes:
    """One record, as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if k.lower() != "content-length")
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages``: a conditional request just before each capture, the capture, and a conditional request after it."""
    tag = F.concat(F.lit('"'), F.left(F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit(16)), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    base = pages.select("page_id", "url", tag.alias("etag"), size.alias("bytes"))

    def kind(name: str, step: int) -> Column:
        ts = F.col("page_id") * 4 + step
        date = F.concat(F.lit("t"), ts.cast("string"))
        own = [F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("bytes")] if name == "response" else [F.lit("Content-Length"), F.lit("0"), F.lit("Set-Cookie"), F.lit("a=1")]
        headers = F.create_map(F.lit("Date"), date, F.lit("ETag"), F.col("etag"), *own)
        return F.struct((F.col("page_id") * 3 + step).alias("record_id"), ts.alias("ts"), F.lit(name).alias("kind"), headers.alias("headers"))

    each = base.select("url", "etag", F.explode(F.array(kind("revisit", 0), kind("response", 1), kind("revisit", 2))).alias("r"))
    return each.select("r.*", "url", "etag", F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"))


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(page_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    target, text = F.coalesce("target_id", F.lit(-1)), F.coalesce(F.array_join(lines, "\n"), F.lit(""))
    return out.select("record_id", "canonical_url", target.alias("target_id"), "state", text.alias("headers"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, '"' || left(md5(coalesce(html, '')), 16) || '"' AS etag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS bytes, trim(url) AS u FROM pages
), q AS (
  SELECT *, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') AS absolute,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)='))) AS pairs
  FROM p
), c AS (
  SELECT page_id, etag, bytes, CASE WHEN absolute THEN host || path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END ELSE u END AS canon FROM q
), visits AS (
  SELECT page_id * 3 + s AS record_id, page_id * 4 + s AS ts, canon, etag FROM c, (VALUES (0), (2)) AS v(s)
), latest AS (
  SELECT v.record_id, arg_max(c.page_id, c.page_id) AS target_page FROM visits v JOIN c ON c.canon = v.canon AND c.page_id * 4 + 1 < v.ts GROUP BY v.record_id
)
SELECT v.record_id, v.canon AS canonical_url,
  CASE WHEN t.etag = v.etag THEN t.page_id * 3 + 1 ELSE -1 END AS target_id,
  CASE WHEN t.page_id IS NULL THEN 'orphan' WHEN t.etag = v.etag THEN 'resolved' ELSE 'mismatch' END AS state,
  CASE WHEN t.etag = v.etag THEN 'content-length: ' || t.bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || v.ts || chr(10) || 'etag: ' || v.etag ELSE '' END AS headers
FROM visits v LEFT JOIN latest l USING (record_id) LEFT JOIN c t ON t.page_id = l.target_page
"""
