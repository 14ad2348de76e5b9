"""WARC captures: records, parsing, and revisits that point to an earlier full response.

A revisit whose HTTP status is 304 holds no body. It stands for the latest full response of the
same canonical URL before it, provided that the validators agree; headers that a 304 may carry
replace the stored ones. The as-of join runs in ranges of (URL, time), so a URL with any share
of all captures is spread over tasks, and bodies never take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch
from cloudgauge.llm.scans import latest

#: Header fields by which a 304 answer updates the stored response. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
CRLF = "\r\n"
#: Query parameters that name a campaign or a session, not a page.
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|sessionid|phpsessid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slash, query parameters in
    order without tracking ones; without scheme and fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}$"))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def warc_record(
    kind: Column, uri: Column, seconds: Column, record_id: Column, status: Column, headers: Column, body: Column
) -> Column:
    """A WARC/1.1 record with an HTTP message, as text. ``headers`` is an array of ``name: value`` strings."""
    http = F.concat(F.lit("HTTP/1.1 "), status, F.lit(CRLF), F.array_join(headers, CRLF), F.lit(CRLF + CRLF), body)
    fields = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.concat(F.lit("Content-Length: "), F.octet_length(http).cast("string")))
    return F.concat(fields, F.lit(CRLF + CRLF), http)


def _headers(block: Column) -> Column:
    """Header fields of a block after its first line as a map; names in lower case, the last of a repeated name counts."""
    lines = F.filter(F.split(block, CRLF), lambda x: x.contains(":"))
    empty = F.create_map().cast("map<string,string>")

    def add(fields: Column, line: Column) -> Column:
        name, at = F.lower(F.trim(F.substring_index(line, ":", 1))), F.instr(line, ":")
        one = F.create_map(name, F.trim(F.substring(line, at + 1, F.length(line))))
        return F.map_concat(F.map_filter(fields, lambda k, _: k != name), one)

    return F.when(block.isNotNull(), F.aggregate(lines, empty, add))


def parse_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """``raw`` with ``warc_type``, ``url``, ``captured_at``, ``record_id``, ``status``, ``headers``, ``body`` and
    ``payload_digest`` in place of ``record``; columns of these names are replaced.

    The HTTP header ends at its first empty line and the body is taken whole. A null or broken record gives
    nulls, which ``resolve_revisits`` reports as ``not_a_revisit``.
    """
    gap, size = CRLF + CRLF, len(CRLF + CRLF)
    whole = F.col(record)
    # substring_index cuts at bytes; positions in characters would count through the body
    split = raw.withColumn("_head", F.substring_index(whole, gap, 1)).withColumn("_rest", F.substring_index(whole, gap, 2))
    split = split.withColumns({
        "_warc": F.when(F.octet_length("_rest") > F.octet_length("_head"), F.col("_head")),
        "_http": F.when(F.octet_length("_rest") > F.octet_length("_head") + size, F.expr(
            f"cast(substring(cast(_rest as binary), octet_length(_head) + {size + 1}) as string)")),
        "_body": F.when(F.octet_length(whole) >= F.octet_length("_rest") + size, F.expr(
            f"substring(cast(`{record}` as binary), octet_length(_rest) + {size + 1})"))}).drop(record, "_head", "_rest")
    split = split.withColumn("_fields", _headers(F.col("_warc"))).withColumn("headers", _headers(F.when(
        F.col("_body").isNotNull(), F.col("_http"))))
    return split.withColumns({
        "warc_type": F.col("_fields")["warc-type"], "url": F.col("_fields")["warc-target-uri"],
        "captured_at": F.try_to_timestamp(F.col("_fields")["warc-date"], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "record_id": F.col("_fields")["warc-record-id"],
        "status": F.regexp_extract("_http", r"^HTTP/\S+ (\d{3})", 1).try_cast("int"), "body": F.col("_body").cast("string"),
        "payload_digest": F.when(F.octet_length("_body") > 0, F.concat(F.lit("md5:"), F.md5("_body"))),
    }).drop("_warc", "_http", "_body", "_fields")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``: ``record_id``, ``canonical``, ``captured_at``, ``outcome``, and of the
    response that it stands for ``response_id``, ``status``, ``headers`` (merged) and ``payload_digest``.

    ``outcome``: ``resolved`` (strong or weak ETags are equal, or without ETags on both sides the
    Last-Modified dates are), ``mismatch`` (validators differ), ``unvalidated`` (nothing to compare),
    ``no_response`` (no earlier full response). Only ``resolved`` rows have a response. A full response is a
    ``response`` record with status 200 and a body. Order is (captured_at, record_id), nulls first; a response of
    the same second counts as earlier if its id is smaller. Records without a URL are each without response.
    Repeated record rows resolve alike, once per row.
    """
    etag = F.regexp_replace(F.col("headers")["etag"], "^W/", "")
    rows = records.select(
        "record_id", "captured_at", "warc_type", "status", "headers", "payload_digest",
        canonical_url(F.col("url")).alias("canonical"), etag.alias("_etag"), F.col("headers")["last-modified"].alias("_modified"))
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("payload_digest").isNotNull()
    revisit = (F.col("warc_type") == "revisit") & (F.col("status") == 304)
    kept = rows.filter(full | revisit).withColumn("_kind", F.when(full, F.lit(0)).otherwise(F.lit(1)))
    # The range partitioning reads its input twice; parsing is done once.
    scratch = Scratch(records.sparkSession)
    kept = scratch.write(kept)
    packed = F.when(F.col("canonical").isNotNull() & (F.col("_kind") == 0), F.struct(
        F.col("record_id").alias("id"), F.col("status").alias("status"), F.col("headers").alias("headers"),
        F.col("payload_digest").alias("digest"), F.col("_etag").alias("etag"), F.col("_modified").alias("modified")))
    joined = latest(kept, ["canonical"], ["captured_at", "record_id", "_kind"], packed, "_response", scratch).filter("_kind = 1")
    was = F.col("_response")
    outcome = (
        F.when(was.isNull() | F.col("canonical").isNull(), "no_response")
        .when(F.col("_etag").isNotNull() & was["etag"].isNotNull(),
              F.when(F.col("_etag") == was["etag"], "resolved").otherwise("mismatch"))
        .when(F.col("_modified").isNotNull() & was["modified"].isNotNull(),
              F.when(F.col("_modified") == was["modified"], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated"))
    fresh = F.map_filter(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")),
                         lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(was["headers"], lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    resolved = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "canonical", "captured_at", "outcome", F.when(resolved, was["id"]).alias("response_id"),
        F.when(resolved, was["status"]).alias("status"), F.when(resolved, merged).alias("headers"),
        F.when(resolved, was["digest"]).alias("payload_digest"))
