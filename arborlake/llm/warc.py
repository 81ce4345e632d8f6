"""WARC records: reading, writing, and resolving "not modified" revisits.

A revisit record says that a URL, fetched again, had not changed: the server answered 304 and
sent validators (ETag, Last-Modified) and a few headers, but no body.  Resolution is an as-of
join: by canonical URL to the latest earlier full response, whose validators must agree, and
whose headers are updated by those that a 304 may carry.

The as-of join needs no group of all captures of a URL.  Times are cut at up to ``chunks``
quantiles, so that a chunk holds about 1/chunks of all rows whatever their URLs; the latest
full response of each (URL, chunk) is a map-side aggregate; a window over at most ``chunks``
rows a URL carries it forward; inside a chunk a window does the rest.  All of this runs on
keys and headers alone; bodies are joined at the end, if asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update (RFC 9110 and RFC 9111), lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not select content.
TRACKING = r"(?:utm_[^=&#]*|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)"

RECORD = "record_id string, warc_type string, url string, ts timestamp, status int, headers map<string,string>, payload binary"


@dataclass(frozen=True)
class Revisit:
    chunks: int = 256


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, user, default port, fragment, tracking parameters, the order of the
    others and a trailing slash or index page play no part; host in lower case."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i:https?)://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(?:80|443)$", ""), r"^www\d?\.", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:index|default)\.(?:html?|php|asp)$", "/"), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^(?i:{TRACKING})(?:=|$)")))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.concat(host, path, tail)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the first holds; null: no header."""
    e = F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("k"), x["value"].alias("v")))
    keys = F.array_distinct(F.transform(e, lambda x: x["k"]))
    m = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(e, lambda x: x["k"] == k), 1)["v"]))
    return F.coalesce(m, F.expr("cast(map() as map<string,string>)"))


def _bare(etag: Column) -> Column:
    """Weak comparison of entity tags."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def resolve_revisits(records: DataFrame, p: Revisit = Revisit(), with_payload: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """records as in ``RECORD`` (of other columns those in ``keep`` are carried along).  One
    row per record: record_id, url_key, warc_type, status, refers_to, validator, resolved,
    headers (merged), the columns of ``keep`` and, if asked for, payload.

    A record of type "revisit" looks for the latest record of type "response" with status 200
    and the same canonical URL that is strictly earlier (of equal times the larger record_id
    counts as later; a response of the revisit's own time is not earlier).  validator:
    ``etag`` or ``last-modified`` if the revisit has it and the response's is equal (an ETag
    decides alone where both have one), ``mismatch`` if it differs, ``none`` if there is
    nothing to compare, ``no-response`` without an earlier response.  resolved: an equal
    validator, or nothing to compare.  Only a resolved revisit refers to the response, has its
    status, and its headers: the response's, with those of ``PERMITTED`` that the revisit has
    in their place.  Other records keep their own; validator is then null and resolved false.

    Null url or time: never joined (``no-response``).  Null headers: none.  Repeated records:
    one row each.  Empty table: empty result."""
    h = lower_keys(F.col("headers"))
    r = records.select(
        F.col("record_id").cast("string").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("url_key"), "ts",
        F.lower(F.col("warc_type").cast("string")).alias("warc_type"), F.col("status").cast("int").alias("status"), h.alias("headers"), *[F.col(c) for c in keep],
    )
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    r = r.withColumn("us", us)
    cuts = sorted(set(r.agg(F.percentile_approx("us", [i / p.chunks for i in range(1, p.chunks)], 100 * p.chunks)).first()[0] or []))
    chunk = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("us"))) if cuts else F.lit(0)
    r = r.withColumn("chunk", chunk)
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    usable = F.col("url_key").isNotNull() & F.col("us").isNotNull()
    response = F.struct("us", "record_id", "status", "headers")

    # Latest response of each (URL, chunk), carried to the URL's later chunks.
    of_chunk = r.where(full & usable).groupBy("url_key", "chunk").agg(F.max_by(response, F.struct("us", "record_id")).alias("last"))
    asked = r.where((F.col("warc_type") == "revisit") & usable)
    marks = of_chunk.select("url_key", "chunk", "last").unionByName(asked.select("url_key", "chunk").distinct(), allowMissingColumns=True)
    marks = marks.groupBy("url_key", "chunk").agg(F.first("last", ignorenulls=True).alias("last"))
    by_url = Window.partitionBy("url_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "chunk", F.last("last", ignorenulls=True).over(by_url).alias("before"))

    # Inside a chunk: responses come after revisits of the same time, so they are not earlier.
    part = r.where(usable & (full | (F.col("warc_type") == "revisit")))
    inside = Window.partitionBy("url_key", "chunk").orderBy("us", F.when(full, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("within", F.last(F.when(full, response), ignorenulls=True).over(inside)).where("warc_type = 'revisit'")
    c = carried.select(F.col("url_key").alias("c_url"), F.col("chunk").alias("c_chunk"), "before")
    part = part.join(c, (F.col("url_key") == F.col("c_url")) & (F.col("chunk") == F.col("c_chunk")), "left")
    part = part.withColumn("base", F.coalesce("within", "before"))

    others = r.where(~F.coalesce((F.col("warc_type") == "revisit") & usable, F.lit(False))).withColumn("base", F.lit(None).cast(part.schema["base"].dataType))
    cols = ["record_id", "url_key", "warc_type", "status", "headers", "base", *keep]
    j = part.select(*cols).unionByName(others.select(*cols))
    mine, theirs = lambda k: F.col("headers")[k], lambda k: F.col("base.headers")[k]
    compared = (
        F.when(mine("etag").isNotNull() & theirs("etag").isNotNull(), F.when(_bare(mine("etag")) == _bare(theirs("etag")), "etag").otherwise("mismatch"))
        .when(mine("last-modified").isNotNull() & theirs("last-modified").isNotNull(), F.when(F.trim(mine("last-modified")) == F.trim(theirs("last-modified")), "last-modified").otherwise("mismatch"))
        .otherwise("none")
    )
    validator = F.when(F.col("warc_type") == "revisit", F.when(F.col("base").isNull(), "no-response").otherwise(compared))
    j = j.withColumn("validator", validator).withColumn("resolved", F.coalesce(F.col("validator").isin("etag", "last-modified", "none"), F.lit(False)))
    new = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("base.headers"), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    out = j.select(
        "record_id", "url_key", "warc_type",
        F.when(F.col("resolved"), F.col("base.status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("resolved"), F.col("base.record_id")).alias("refers_to"),
        "validator", "resolved",
        F.when(F.col("resolved"), merged).otherwise(F.col("headers")).alias("headers"), *keep,
    )
    if with_payload:
        body = records.select(F.col("record_id").cast("string").alias("b_id"), "payload").groupBy("b_id").agg(F.first("payload", ignorenulls=True).alias("payload"))
        out = out.join(body, F.coalesce("refers_to", "record_id") == F.col("b_id"), "left").drop("b_id")
    return out


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` seen as captures.  Each page is a full response, a second after the one with
    the id before, with Last-Modified and, but for every fifth, an ETag.  By a digest of its
    id every third page is fetched again a day later; the server answers "not modified" with
    the validators that the page had, or, for every seventh, with those of another state.
    page_id goes along."""
    n = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 6), 16, 10).cast("long")
    digest = F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    none = F.expr("cast(map() as map<string,string>)")
    t = F.lit(1_704_067_200) + F.col("page_id").cast("long")

    def headers(state: Column, date: Column, rest: Column) -> Column:
        tag = F.when(n % 5 != 0, F.create_map(F.lit("ETag"), F.concat(F.lit('"'), state, F.lit('"')))).otherwise(none)
        return F.map_concat(F.create_map(F.lit("Last-Modified"), F.substring(state, 1, 8), F.lit("Date"), date.cast("string")), tag, rest)

    page = F.col("page_id").cast("long").alias("page_id")
    first = pages.select(
        page, F.col("page_id").cast("string").alias("record_id"), F.lit("response").alias("warc_type"), "url", F.timestamp_seconds(t).alias("ts"), F.lit(200).alias("status"),
        headers(digest, t, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("no-store"))).alias("headers"), F.col("html").cast("binary").alias("payload"),
    )
    state = F.when(n % 7 == 0, F.reverse(digest)).otherwise(digest)
    again = pages.where(n % 3 == 0).select(
        page, F.concat(F.col("page_id").cast("string"), F.lit("-again")).alias("record_id"), F.lit("revisit").alias("warc_type"), "url", F.timestamp_seconds(t + 86_400).alias("ts"), F.lit(304).alias("status"),
        headers(state, t + 86_400, F.create_map(F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Type"), F.lit("none"))).alias("headers"), F.lit(None).cast("binary").alias("payload"),
    )
    return first.unionAll(again)


def parse_records(data: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of a WARC stream, one at a time, as rows of ``RECORD``."""
    while True:
        line = data.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _headers(data)
        body = data.read(int(head.get("content-length", "0")))
        status, headers, payload = None, {}, body
        if head.get("content-type", "").lower().startswith("application/http"):
            http = io.BytesIO(body)
            first = http.readline().split(None, 2)
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            headers, payload = _headers(http), http.read()
        ts = pd.Timestamp(head["warc-date"]).tz_convert(None) if "warc-date" in head else None
        yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), ts, status, headers, payload or None


def _headers(data: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in iter(data.readline, b""):
        if not line.strip():
            break
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out.setdefault(k.strip().lower(), v.strip())
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files under ``path``, through Spark's own file reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "warc_type", "url", "ts", "status", "headers", "payload"]
        for pdf in batches:
            for content in pdf["content"]:
                raw = io.BytesIO(content)
                data = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                held: list[tuple] = []
                for record in parse_records(data):
                    held.append(record)
                    if len(held) == 256:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return files.select("content").mapInPandas(run, RECORD)


def write_record(out, record_id: str, warc_type: str, url: str, date: str, status: int, headers: dict[str, str], payload: bytes) -> None:
    """Append one HTTP record to an open binary file."""
    http = f"HTTP/1.1 {status} -\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    head = {"WARC-Type": warc_type, "WARC-Record-ID": record_id, "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http", "Content-Length": len(http)}
    out.write(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + http + b"\r\n\r\n")


#: The rows of query op10 in DuckDB.
ORACLE = r"""
WITH u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') AS u FROM pages),
v AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(?:80|443)$', ''), '^www\d?\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/(?:index|default)\.(?:html?|php|asp)$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:(?:utm_[^=&#]*|gclid|fbclid|ref|sessionid|phpsessid|jsessionid))(?:=|$)'))) AS q
  FROM u),
k AS (
  SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key,
    md5(coalesce(html, '')) AS digest, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 6))::BIGINT AS n, 1704067200 + page_id AS t
  FROM v),
f AS (SELECT page_id, page_id::VARCHAR AS record_id, url_key, t, CASE WHEN n % 5 <> 0 THEN '"' || digest || '"' END AS etag, substr(digest, 1, 8) AS modified FROM k),
g AS (
  SELECT page_id, page_id::VARCHAR || '-again' AS record_id, url_key, t + 86400 AS t,
    CASE WHEN n % 7 = 0 THEN reverse(digest) ELSE digest END AS state, n FROM k WHERE n % 3 = 0),
g2 AS (SELECT *, CASE WHEN n % 5 <> 0 THEN '"' || state || '"' END AS etag, substr(state, 1, 8) AS modified FROM g),
j AS (
  SELECT g2.*, b.record_id AS b_id, b.etag AS b_etag, b.modified AS b_modified
  FROM g2 ASOF LEFT JOIN f b ON g2.url_key = b.url_key AND g2.t > b.t),
w AS (
  SELECT *, CASE WHEN b_id IS NULL THEN 'no-response'
    WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'etag' ELSE 'mismatch' END
    WHEN modified = b_modified THEN 'last-modified' ELSE 'mismatch' END AS validator
  FROM j),
x AS (SELECT *, validator IN ('etag', 'last-modified') AS resolved FROM w)
SELECT page_id, record_id, url_key, 'revisit' AS warc_type, validator, resolved,
  (CASE WHEN resolved THEN 200 ELSE 304 END)::INTEGER AS status, CASE WHEN resolved THEN b_id END AS refers_to,
  CASE WHEN resolved THEN coalesce(etag, b_etag) ELSE etag END AS etag, t::VARCHAR AS date,
  'max-age=60' AS cache_control, CASE WHEN resolved THEN 'text/html' ELSE 'none' END AS content_type
FROM x
UNION ALL
SELECT page_id, record_id, url_key, 'response', NULL, false, 200::INTEGER, NULL, etag, t::VARCHAR, 'no-store', 'text/html' FROM f
"""
