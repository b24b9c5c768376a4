"""WARC derivatives: response records into metadata and plain-text records.

Each response yields a ``metadata`` record (title, language, out-links) and a
``conversion`` record (the page as plain text). Both name the response they
derive from (WARC-Refers-To, its URI and date), keep the source's HTTP headers,
and carry block and payload digests. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that end a line, and character references, ``&amp;`` last.
BREAKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre|title|main|aside|form|hr"
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
CRLF = "\r\n"


def record_id(*parts: Column) -> Column:
    """A ``urn:uuid`` that depends on the parts only, in the form of version 5."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-a"), at(18, 3), F.lit("-"), at(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    """A labelled digest of the text's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def unreference(text: Column) -> Column:
    """Character references replaced."""
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """The page's text: no comments, scripts, styles or tags; blocks on lines of their own."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)[ \t\r\n]*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BREAKS})(?:[ \t\r\n/][^>]*)?>", "\n")
    out = unreference(F.regexp_replace(out, r"<[^>]*>", ""))
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages (page_id, url, html).

    Columns: page_id, record_id, target_uri, date, http_headers, payload.
    Null url or html counts as empty. Rows with equal values get equal ids.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(html, 256)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        html.alias("payload"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows, ``metadata`` and ``conversion``, for each response record.

    Columns: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, payload_digest (of the response's payload),
    block, block_digest, content_length, header (the record's own header).
    """
    body = F.col("payload")
    links = F.transform(F.regexp_extract_all(body, F.lit(r"""(?i)<a [^>]*href="([^"]*)\""""), F.lit(1)), unreference)
    title = F.regexp_replace(unreference(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[ \t\r\n]+", " ")
    fields = F.concat(
        F.lit("title: "),
        title,
        F.lit(f"{CRLF}languages: "),
        F.regexp_extract(body, r"""(?i)<html[^>]*lang="([^"]*)\"""", 1),
        F.lit(f"{CRLF}source-"),
        F.replace(F.regexp_replace(F.col("http_headers"), r"\r\n$", ""), F.lit(CRLF), F.lit(f"{CRLF}source-")),
        F.lit(CRLF),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(body).alias("block")),
    )
    rows = records.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), digest(body).alias("payload_digest"), F.inline(kinds))
    rows = rows.withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to"))).withColumn("block_digest", digest(F.col("block")))
    rows = rows.withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length")),
    )
    return rows.withColumn("header", header)
