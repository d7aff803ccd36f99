"""Derived web-archive records: a metadata and a plain-text conversion record for every response.

Both refer to the response by its identifier and name each other as concurrent; they carry the target
address, the date and the digest of the source, and the metadata record repeats the source's HTTP headers,
its title, language and links. Identifiers and digests follow from the contents, so reruns agree.
Expressions only; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import let
from corpuslens.llm.common import whole_text

BLANK = r"[ \t\r\n\x0B\f]"
# Elements without readable text, elements that end a line, and the entities with a name.
UNREAD = (
    r"(?is)<!--.*?-->"
    r"|<script[^>]*>.*?</script[^>]*>"
    r"|<style[^>]*>.*?</style[^>]*>"
    r"|<noscript[^>]*>.*?</noscript[^>]*>"
    r"|<template[^>]*>.*?</template[^>]*>"
    rf"|<head(?:{BLANK}[^>]*)?>.*?</head[^>]*>"
)
LINE_END = (
    r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr"
    rf"|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[/ \t\r\n\x0B\f][^>]*)?>"
)
ANY_TAG = r"<[a-zA-Z/!?][^>]*>"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "euro": "€", "laquo": "«", "raquo": "»", "middot": "·", "times": "×",
}
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = rf"""(?is)<html[^>]*{BLANK}lang{BLANK}*={BLANK}*["']([a-zA-Z-]+)"""
HREF = rf"""(?is)<a{BLANK}[^>]*?href{BLANK}*={BLANK}*["']([^"']*)["']"""


def unescaped(text: Column) -> Column:
    """Entities with a name of ``ENTITIES`` or a code point replaced; others stay as they are."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        code = F.when(
            name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10).cast("int")
        ).otherwise(F.substring(name, 2, 8).cast("int"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        found = F.when(name.startswith("#"), F.when(valid, char)).otherwise(F.try_element_at(named, name))
        rest = F.substr(part, F.length(name) + 2)
        whole = F.concat(F.lit("&"), part)
        return F.when(i == 0, part).when(name == "", whole).otherwise(F.coalesce(F.concat(found, rest), whole))

    # bound once: the text is a chain of replacements, and it is read several times here
    return let(text, lambda t: F.when(~F.contains(t, F.lit("&")), t).otherwise(F.array_join(F.transform(F.split(t, "&"), one), "")))


def tidy(text: Column) -> Column:
    """Runs of blanks as one space, lines without blanks at their ends, no empty lines."""
    spaced = F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")
    return F.btrim(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    read = F.regexp_replace(html, UNREAD, "")
    lines = F.regexp_replace(F.regexp_replace(read, BLANK + "+", " "), LINE_END, "\n")
    return tidy(unescaped(F.regexp_replace(lines, ANY_TAG, "")))


def one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, BLANK + "+", " "))


def urn(*parts: Column) -> Column:
    """A name-based identifier of the parts."""
    h = F.md5(F.concat_ws("\n", *[whole_text(p) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table (page_id, url, html); the page has no headers of its own to keep."""
    html = whole_text(F.col("html"))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
    )
    return pages.select(
        "page_id",
        urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        html.alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"),
    )


def derive(responses: DataFrame, keep: list[str]) -> DataFrame:
    """A metadata and a conversion record for each response.

    ``responses``: (record_id, target_uri, date, http_headers, payload, payload_digest). A digest that the
    source does not give is computed. ``keep`` names columns to carry along. Nulls count as empty text and a
    null address stays null; an empty page gives an empty conversion block; repeated responses give repeated
    records.
    """
    payload = whole_text(F.col("payload"))
    read = responses.select(
        *keep,
        F.col("record_id").alias("refers_to"),
        F.regexp_replace(F.col("target_uri"), r"[\r\n]", "").alias("target_uri"),
        "date",
        F.coalesce("payload_digest", digest(payload)).alias("source_digest"),
        whole_text(F.col("http_headers")).alias("_headers"),
        one_line(unescaped(F.regexp_extract(payload, TITLE, 1))).alias("_title"),
        F.regexp_extract(payload, LANGUAGE, 1).alias("_language"),
        F.transform(F.regexp_extract_all(payload, F.lit(HREF), 1), lambda u: one_line(unescaped(u))).alias("_links"),
        plain_text(payload).alias("_text"),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat(
        line("title", F.col("_title")),
        line("language", F.col("_language")),
        F.array_join(F.transform(F.split("_headers", "\r\n"), lambda h: line("source-header", h)), ""),
        F.array_join(F.transform("_links", lambda u: line("outlink", u)), ""),
    )
    own = {kind: urn(F.lit(kind), F.col("refers_to"), F.col("source_digest")) for kind in ("metadata", "conversion")}
    record = lambda kind, other, content, block: F.struct(
        F.lit(kind).alias("warc_type"),
        own[kind].alias("record_id"),
        own[other].alias("concurrent_to"),
        F.lit(content).alias("content_type"),
        block.alias("block"),
    )
    both = F.array(
        record("metadata", "conversion", "application/warc-fields", fields),
        record("conversion", "metadata", "text/plain; charset=utf-8", F.col("_text")),
    )
    return (
        read.select(*keep, "refers_to", "target_uri", "date", "source_digest", F.explode(both).alias("r"))
        .select(*keep, "refers_to", "target_uri", "date", "source_digest", "r.*")
        .withColumn("block_digest", digest(F.col("block")))
        .withColumn("content_length", F.octet_length("block").cast("long"))
    )


def rendered(records: DataFrame) -> Column:
    """A record as archive text, without the two line ends after its block."""
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("warc_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.concat(F.lit("WARC-Concurrent-To: "), F.col("concurrent_to")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("source_digest")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), F.col("block"))


def write_archive(records: DataFrame, location: str) -> None:
    """Archive files of the records; every task writes its own."""
    text = records.select(rendered(records).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(location)
