"""WARC records, and not-modified revisits resolved by an as-of join.

Records are written and read in the format of ISO 28500 (header lines, blank line, block, two line ends), each optionally a
gzip member of its own, with the mandatory WARC-Record-ID, WARC-Date, WARC-Type and Content-Length. A revisit of the profile
server-not-modified carries the headers of a 304 answer and no body; it may name the record that it refers to (WARC-Refers-To, with its
target and date). It is resolved to the latest earlier full response (status 200) of the same canonical URL: validators are checked (a
strong or weak ETag if both have one, else Last-Modified if both have one), and the headers that a 304 may update replace those of the
stored response. Whether the response found is the one that the revisit names is told, not taken for granted.

The as-of join does not gather a URL's captures: time is cut into days and these into minutes; the last full response of each (URL, minute)
and (URL, day) is found by pre-aggregation and carried over a day's minutes, and over days, by windows over these alone; only captures of
one URL and minute are ordered together; so a URL that holds a third of all captures is spread over its minutes. Bodies do not travel: a
resolved revisit names the record that has its body.

Defined cases: null html is an empty body; a null url has no canonical form and is never resolved (verdict `no url`); a record without a
readable WARC-Date has no time: it serves no revisit, and as a revisit gets the verdict `no date`; one without WARC-Record-ID is named
by a digest of its bytes; of captures with the same URL and time the larger record_id is later, and of captures that repeat a record_id too,
one is taken by a fixed rule; repeated rows give repeated captures; other columns are ignored; no captures give no rows. Damaged
records raise ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._util import chunks, materialize, small_batches, table

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Fields of a 304 answer that replace the stored response's: RFC 9110, section 15.4.5, and RFC 9111, section 4.3.4.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "warning")
#: Microseconds of the slices of time: captures of one URL and minute are ordered together, minutes of one URL and day, and days of one URL.
SLICES = (60_000_000, 86_400_000_000)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def write_record(kind: str, fields: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items())
    record = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, 1, mtime=0) if compress else record


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record. A record that is cut short raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                fields[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 4 + size + 4


def record_fields(name: str, time: int, target: str | None = None, profile: str | None = None, refers_to: tuple[str, str | None, int] | None = None) -> dict[str, str]:
    """The named fields of a record. name: any text that is the record's own; time: microseconds since 1970; refers_to: (name, target, time)."""
    fields = {"WARC-Record-ID": record_id(name), "WARC-Date": warc_date(time)}
    if target is not None:
        fields["WARC-Target-URI"] = target
    if profile is not None:
        fields["WARC-Profile"] = profile
    if refers_to is not None:
        fields |= {"WARC-Refers-To": record_id(refers_to[0]), "WARC-Refers-To-Date": warc_date(refers_to[2])}
        if refers_to[1] is not None:
            fields["WARC-Refers-To-Target-URI"] = refers_to[1]
    return fields


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_date(time: int) -> str:
    moment = _EPOCH + timedelta(microseconds=time)
    return moment.isoformat(timespec="microseconds" if moment.microsecond else "seconds").replace("+00:00", "Z")


def read_date(value: str | None) -> int | None:
    """Microseconds since 1970; null for what is no date. Without a zone it is UTC."""
    try:
        moment = datetime.fromisoformat((value or "").strip())
    except ValueError:
        return None
    return (moment.replace(tzinfo=moment.tzinfo or UTC) - _EPOCH) // timedelta(microseconds=1)


def http_message(status: str, headers: list[tuple[str, str]], body: bytes = b"") -> bytes:
    return (f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode("utf-8", "replace") + body


def read_http(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers by lower-case name (repeats joined by comma), body."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return int(first.split(" ")[1]), headers, body


def canonical_url(url: Column) -> Column:
    """Scheme and `www.` dropped, host in lower case without a default port, no fragment, tracking parameters out, the rest sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(r"^(?i:utm_[a-z]+|ref|fbclid|gclid)="))
    query = F.array_join(F.array_sort(query), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


CAPTURE = "page_id long, record_id string, kind string, time long, url string, status int, headers map<string,string>, body_sha256 string, body_bytes long, named string"


def captures(records: DataFrame) -> DataFrame:
    """Rows of CAPTURE from (page_id, data), one or more WARC records in data each; named: the record that a revisit refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "data"):
            out = []
            for number, data in zip(chunk["page_id"].to_pylist(), chunk["data"].to_pylist(), strict=True):
                for fields, block in read_records(data or b""):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit") or kind == "revisit" and fields.get("warc-profile") != NOT_MODIFIED:
                        continue
                    status, headers, body = read_http(block)
                    own = fields.get("warc-record-id") or f"urn:sha256:{hashlib.sha256(repr(sorted(fields.items())).encode() + block).hexdigest()}"
                    out.append((number, own, kind, read_date(fields.get("warc-date")), fields.get("warc-target-uri"), status, list(headers.items()), hashlib.sha256(body).hexdigest(), len(body), fields.get("warc-refers-to")))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in CAPTURE.split(", ")])

    small_batches(records.sparkSession)
    return records.select("page_id", "data").mapInArrow(run, CAPTURE)


def keyed(found: DataFrame) -> DataFrame:
    """Captures with their canonical URL (key), day and minute: worked out once, where the result is stored."""
    minute, day = SLICES
    return found.withColumn("key", canonical_url(F.col("url"))).withColumn("day", F.floor(F.col("time") / day)).withColumn("minute", F.floor(F.col("time") / minute))


def resolve(found: DataFrame) -> DataFrame:
    """One row for each revisit: page_id, record_id, url, verdict, refers_to, as_named, status, headers, body_sha256, body_bytes.

    verdict: resolved, validator mismatch, no validator, no earlier response, no url, no date. Only resolved revisits have a body's digest
    and merged headers. as_named: whether refers_to is the record that the revisit names (null if it names none or none was found)."""
    rows = found if {"key", "day", "minute"} <= set(found.columns) else keyed(found)
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    named = rows.filter("key is not null and time is not null")
    revisits = named.filter("kind = 'revisit'")
    # the last full response of each minute, of a day's minutes before it, and of the days before that
    order = F.struct("time", "record_id")
    of_minute = named.filter(full).groupBy("key", "day", "minute").agg(F.max(order).alias("at"))
    of_day = of_minute.groupBy("key", "day").agg(F.max("at").alias("at"))

    def carried(slots: DataFrame, last: DataFrame, within: list[str], by: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return slots.distinct().join(last, [*within, by], "full").select(*within, by, F.max("at").over(before).alias(f"before_{by}"))

    minutes = carried(revisits.select("key", "day", "minute"), of_minute, ["key", "day"], "minute")
    days = carried(revisits.select("key", "day"), of_day, ["key"], "day")
    within = Window.partitionBy("key", "day", "minute").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    narrow = named.select("key", "day", "minute", "time", "record_id", "kind", F.when(full, order).alias("own"))
    seen = narrow.withColumn("seen", F.max("own").over(within)).filter("kind = 'revisit'").join(minutes, ["key", "day", "minute"], "left").join(days, ["key", "day"], "left")
    chosen = seen.groupBy("key", "time", "record_id").agg(F.min(F.coalesce("seen", "before_minute", "before_day")).alias("of"))
    chosen = chosen.select("key", "time", "record_id", F.col("of.time").alias("of_time"), F.col("of.record_id").alias("of_id"))
    asked = rows.filter("kind = 'revisit'").select("page_id", "record_id", "time", "key", "named", F.col("headers").alias("sent")).join(chosen, ["key", "time", "record_id"], "left")
    # of captures that repeat URL, time and record_id one is taken: maps have no order, their entries do
    entries = F.array_sort(F.map_entries("headers"))
    stored = F.struct("body_sha256", "body_bytes", "status", entries.alias("entries"))
    bodies = named.filter(full).groupBy(F.col("key").alias("of_key"), F.col("time").alias("of_time"), F.col("record_id").alias("of_id")).agg(F.min(stored).alias("one"))
    bodies = bodies.select("of_key", "of_time", "of_id", F.struct(F.col("of_id").alias("record_id"), "one.status", F.map_from_entries("one.entries").alias("headers"), "one.body_sha256", "one.body_bytes").alias("stored"))
    joined = asked.join(bodies, (asked["key"] == bodies["of_key"]) & (asked["of_time"] == bodies["of_time"]) & (asked["of_id"] == bodies["of_id"]), "left").select("page_id", asked["record_id"], "time", "key", "named", "sent", "stored")

    def both(name: str) -> Column:
        return F.col("sent")[name].isNotNull() & F.col("stored.headers")[name].isNotNull()

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^W/", "")

    same = F.when(both("etag"), bare(F.col("sent")["etag"]) == bare(F.col("stored.headers")["etag"])).when(both("last-modified"), F.col("sent")["last-modified"] == F.col("stored.headers")["last-modified"])
    verdict = F.when(F.col("key").isNull(), "no url").when(F.col("time").isNull(), "no date").when(F.col("stored").isNull(), "no earlier response").when(same.isNull(), "no validator").when(same, "resolved").otherwise("validator mismatch")
    joined = joined.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    fresh = F.map_filter("sent", lambda k, _: k.isin(*UPDATES))
    kept = F.map_filter("stored.headers", lambda k, _: ~F.map_contains_key(fresh, k))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(kept, fresh)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return joined.select(
        "page_id",
        "record_id",
        F.col("key").alias("url"),
        "verdict",
        F.col("stored.record_id").alias("refers_to"),
        (F.col("stored.record_id") == F.col("named")).alias("as_named"),
        F.when(ok, F.col("stored.status")).alias("status"),
        F.when(ok, merged).alias("headers"),
        F.when(ok, F.col("stored.body_sha256")).alias("body_sha256"),
        F.when(ok, F.col("stored.body_bytes")).alias("body_bytes"),
    )


#: Microseconds between two pages' visits, and between two captures of one page, in the history that is made of pages.
_STEP, _AGAIN = 60_000_000, 5_400_000_000
START = 1_700_000_000_000_000


def records_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, data): a capture history made of pages, for a table that has none; one row for each record.

    Page n is captured in full 1 + n mod 2 times, one and a half hours apart, with other bodies but for the last time, and visited again 20 seconds
    after that, under another spelling of its URL. Of seven pages one has changed (its ETag differs), one was never captured in full, one is
    answered without a validator, and one has only Last-Modified. With every third page the same robots.txt is asked for again, which
    is captured in full with every 300th: a URL of very many captures over the whole time. A null page_id counts by a digest of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            out = []
            for page_id, url, body in zip(chunk["page_id"].to_pylist(), chunk["url"].to_pylist(), chunk["html"].to_pylist(), strict=True):
                body = (body or "").encode()
                digest = hashlib.md5(body).hexdigest()
                n = page_id if page_id is not None else int(hashlib.md5(f"{url} {digest}".encode()).hexdigest()[:6], 16)
                name, visit, kind = f"{page_id} {url} {digest}", START + n * _STEP, n % 7
                tag = f'"{digest[:16]}"'
                target = url.replace("\r", " ").replace("\n", " ") if url is not None else None
                changed = ("Last-Modified", f"day {n // 7}")
                named = None
                for k in range(1 + n % 2 if kind != 2 else 0):
                    left = n % 2 - k
                    own = body if not left else body[: len(body) // (left + 1)]
                    headers = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(own))), ("Date", f"capture {k}"), ("Cache-Control", "max-age=60"), ("Server", "example"), changed if not left else ("Last-Modified", f"day {n // 7} less {left}")]
                    if kind != 5:
                        headers.append(("ETag", tag if not left else f'"{left}-{digest[:12]}"'))
                    named = (f"{name} {k}", target, visit - left * _AGAIN)
                    out.append((page_id, write_record("response", record_fields(named[0], named[2], target), http_message("200 OK", headers, own))))
                answer = [("Date", "visit"), ("Cache-Control", "max-age=600"), ("Server", "other"), ("X-Cache", "HIT")]
                answer += {1: [("ETag", '"changed"')], 3: [], 5: [changed]}.get(kind, [("ETag", f"W/{tag}" if kind == 6 else tag)])
                other = target.split("#")[0] + "#again" if target is not None else None
                out.append((page_id, write_record("revisit", record_fields(f"{name} again", visit + 20_000_000, other, NOT_MODIFIED, named), http_message("304 Not Modified", answer))))
                if n % 3 == 0:
                    robots, at, hour = "http://hot.example/robots.txt", visit + 30_000_000, [("ETag", f'"{n // 300}"'), ("Date", f"page {n}")]
                    kind, message, profile = ("response", http_message("200 OK", hour, b"Allow: /\n"), None) if n % 300 == 0 else ("revisit", http_message("304 Not Modified", hour), NOT_MODIFIED)
                    out.append((page_id, write_record(kind, record_fields(f"{name} robots", at, robots, profile), message)))
            number, data = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["page_id", "data"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, data binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the history that is made of pages, resolved."""
    return resolve(materialize(keyed(captures(records_of_pages(table(spark, sf_dir, "pages")))), "captures"))
