"""WARC: not-modified revisits resolved to the full response that they stand for.

A revisit takes the latest full response of its canonical URL that is strictly earlier (an as-of join; of several at that
time, the one of the largest record id) and is resolved if the validators agree: entity tags if both have
one, else modification dates if both have one, else payload digests. A resolved revisit gets the stored response's
headers, with those that a not-modified answer may update taken from the revisit; body and its description stay.

The as-of join runs in two levels, so that one URL may hold any share of the captures: inside slices of time by a
window, then across slices over one row a slice.

Nulls: a capture without URL or time resolves nothing and stays unresolved; null headers are none. Repeated records
each get a row. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick

#: Headers that a not-modified answer may update (fixed values of RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
COLUMNS = ["record_id", "url", "ts", "kind", "digest", "headers"]
SLICE_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Host and path in one spelling: no scheme, www, default port, user or fragment, trailing slash or tracking query."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^:/?#]+://([^/?#]*)", 1)), "(^[^@]*@)|(:(80|443)$)", "")
    rest = F.regexp_replace(u, "^[^:/?#]+://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(rest, r"\?(.*)$", 1)), "&((utm_[a-z]+|gclid|fbclid)=[^&]*)?$|&(utm_[a-z]+|gclid|fbclid)=[^&]*", "")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(F.length(query) > 1, F.concat(F.lit("?"), F.substring(query, F.lit(2), F.length(query)))).otherwise(""))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures: record_id, url, ts, kind ('response' or 'revisit'), digest, headers (map of lower-case names). A row for
    each revisit: record_id, canonical_url, resolved, source_id, digest and headers."""
    rows = pick(captures, *COLUMNS).withColumn("key", canonical_url(F.col("url")))
    rows = cut(rows.filter("kind in ('response', 'revisit')"), "warc-captures")
    lo, hi, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    slices = max(1, -(-n // SLICE_ROWS))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    full = F.col("kind") == "response"
    placed = F.col("key").isNotNull() & F.col("ts").isNotNull()
    lost = rows.filter(~placed & (F.col("kind") == "revisit"))  # nothing to join, so they meet in no window
    rows = rows.filter(placed).withColumns({"slice": F.floor((F.col("ts") - F.lit(lo or 0)) / width), "full": F.when(full, F.struct("record_id", "digest", "headers")), "later": F.col("kind") == "revisit"})
    # revisits stand before the responses of their time, so what a revisit has before it is strictly earlier
    near = Window.partitionBy("key", "slice").orderBy("ts", F.desc("later"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.last("full", ignorenulls=True).over(near)).filter("later").drop("full")
    ends = rows.filter(F.col("full").isNotNull()).groupBy("key", "slice").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    # what a slice starts with: the last response of the latest earlier slice
    marks = ends.unionByName(rows.filter("later").select("key", "slice").distinct().withColumn("full", F.lit(None).cast(ends.schema["full"].dataType)))
    marks = marks.groupBy("key", "slice").agg(F.max_by("full", F.col("full").isNotNull()).alias("full"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = marks.select("key", "slice", F.last("full", ignorenulls=True).over(before).alias("far"))
    out = inside.join(starts, ["key", "slice"], "left").withColumn("of", F.coalesce("near", "far")).select("record_id", "key", "digest", "headers", "of")
    out = out.unionByName(lost.select("record_id", "key", "digest", "headers", F.lit(None).cast(out.schema["of"].dataType).alias("of")))
    head = lambda c, name: F.element_at(F.coalesce(c, F.create_map().cast("map<string,string>")), F.lit(name))
    own, old = F.col("headers"), F.col("of.headers")
    tag = lambda c: F.regexp_replace(head(c, "etag"), "^W/", "")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    date = lambda c: head(c, "last-modified")
    agree = F.when(both(tag(own), tag(old)), tag(own) == tag(old)).when(both(date(own), date(old)), date(own) == date(old)).otherwise(F.col("digest") == F.col("of.digest"))
    resolved = F.col("of").isNotNull() & F.coalesce(agree, F.lit(False))
    none = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce(own, none), lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, v: ~F.map_contains_key(update, k)), update)
    return out.withColumn("resolved", resolved).select(
        "record_id", F.col("key").alias("canonical_url"), "resolved", F.when(F.col("resolved"), F.col("of.record_id")).alias("source_id"),
        F.when(F.col("resolved"), F.col("of.digest")).alias("digest"), F.when(F.col("resolved"), merged).alias("headers"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files (plain or gzip, read by Spark) as record_id, url, ts (seconds), kind, digest, headers, body. A file is
    read by one task, as archives are written in files of bounded size. Records of other kinds are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = list(parse_warc(raw.as_py()))
                yield pa.RecordBatch.from_pylist(rows, schema=_WARC)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "record_id string, url string, ts long, kind string, digest string, headers map<string,string>, body binary")


_WARC = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])


def _fields(block: bytes) -> list[tuple[str, str]]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)]


def _unpacked(raw: bytes, step: int = 1 << 16) -> bytes:
    """All members, one a record. They are fed in steps, so that what a member leaves over is short: time is linear."""
    out, at = [], 0
    while raw[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof and at < len(raw):
            part = raw[at : at + step]
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        out.append(d.flush())
    return b"".join(out)


def parse_warc(raw: bytes) -> Iterator[dict]:
    import datetime

    if raw[:2] == b"\x1f\x8b":
        raw = _unpacked(raw)
    at = raw.find(b"WARC/")
    while at >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        named = dict(_fields(raw[at:end]))
        size = int(named.get("content-length", "0"))
        block = raw[end + 4 : end + 4 + size]
        head, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        date = named.get("warc-date")
        ts = int(datetime.datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp()) if date else None
        yield {"record_id": named.get("warc-record-id"), "url": named.get("warc-target-uri"), "ts": ts, "kind": named.get("warc-type"), "digest": named.get("warc-payload-digest"), "headers": list(dict(_fields(head)).items()), "body": body}
        at = raw.find(b"WARC/", end + 4 + size)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log that the pages table stands for: each page fetched in full, then asked again under another spelling of
    its URL with the tag it had, asked once more after pages of an even length had changed. Every page takes part."""
    p = pick(pages, "page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    tag, day, even = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"')), F.date_format(F.date_add(F.lit("2024-01-01"), F.pmod(F.col("page_id"), F.lit(300)).cast("int")), "yyyy-MM-dd"), F.length(F.coalesce("html", F.lit(""))) % 2 == 0
    name = lambda x: F.concat(F.lit(f"{x}:"), F.col("page_id").cast("string"))
    heads = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    record = lambda x, ts, kind, url, digest, headers: F.struct(name(x).alias("record_id"), url.alias("url"), (F.col("page_id") * 10 + ts).cast("long").alias("ts"), F.lit(kind).alias("kind"), digest.alias("digest"), headers.alias("headers"))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    new = F.concat(F.lit('"n'), F.substring("digest", 1, 12), F.lit('"'))
    rows = F.array(
        record("a", 1, "response", F.col("url"), F.col("digest"), heads("content-type", "text/html", "etag", tag, "date", day)),
        record("b", 2, "revisit", other, F.col("digest"), heads("etag", F.concat(F.lit("W/"), tag), "cache-control", "max-age=60", "content-type", "text/plain", "date", day)),
        F.when(even, record("c", 3, "response", F.col("url"), F.sha1(F.col("digest")), heads("content-type", "text/html", "etag", new))),
        record("d", 4, "revisit", other, F.col("digest"), heads("etag", tag, "expires", "0")),
    )
    return p.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*")
