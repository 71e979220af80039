"""Derivatives of WARC responses: a metadata and a plain-text conversion record for each.

A response is a row of ``RESPONSE``: its WARC headers and its HTTP message.  From it come two records that name it in
``WARC-Refers-To``: ``conversion``, the payload as plain text, and ``metadata``, warc-fields with the source's headers, digests and
links and the id of the conversion.  Record ids are UUIDs made from the source's id, so a rerun makes the same records.

HTML becomes text by fixed replacements in column expressions: what is not shown (comments, scripts, styles, the title) goes,
tags of blocks end lines, other tags go, character references are read, white space is collapsed.  Other text of a head is shown,
as it ends the head.  Links come with or without quotes; blanks inside are written ``%20``, those around and line ends go.

Defined results: a message is HTML if its Content-Type line says so, or if it has no header block; NULL ids, addresses, dates and messages count as empty; a message without a header block is all payload; an empty
payload gives an empty text; repeated rows give repeated records; no rows give no records.
"""

from __future__ import annotations

import functools
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.text import let

RESPONSE = "record_id string, target_uri string, date string, http string"
CRLF = "\r\n"

_ATTRIBUTES = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
_BLANK = "\t\n\f\r \u00a0"
#: What is not shown, in one pass; patterns read the same to Java and RE2.
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|"
    + "|".join(rf"{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "noscript", "template", "title"))
    + ")"
)
#: Tags that end a line become this character until white space is settled.
BREAK = "\x01"
TAGS = [
    (
        r"(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|aside|main|blockquote|pre"
        rf"|figure|form|hr|br|body|html)\b{_ATTRIBUTES}>",
        BREAK,
    ),
    (rf"</?[A-Za-z!?]{_ATTRIBUTES}>", ""),
]
#: Runs of white space other than one plain space, then breaks with what is around them.
COLLAPSE = [
    (f"(?:[{_BLANK.replace(' ', '')}]| [{_BLANK}])[{_BLANK}]*", " "),
    (f" ?{BREAK}[{BREAK} ]*", "\n"),
]
#: Named references, by the HTML standard's table (a no-break space becomes a plain one); the usual ones are looked for first.
NAMED = {name[:-1]: text.replace("\u00a0", " ") for name, text in html5.items() if name.endswith(";")}
USUAL = ("nbsp", "lt", "gt", "quot", "apos", "amp")
REFERENCE = r"\A(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
HTML_TYPE = r"(?i)(?:\A|\n)content-type:[ \t]*(?:text/html|application/xhtml\+xml)[ \t]*(?:[;\r\n]|\z)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = "^[\"']|[\"']$"
LINE_PARTS = "[\t\n\f\r]"


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return functools.reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def _references(text: Column) -> Column:
    """Character references read: the text is cut at ampersands and each piece looked at once."""

    def character(name: Column) -> Column:
        code = F.regexp_extract(name, r"\A#([0-9]+)\z", 1)
        digits = F.regexp_extract(name, r"\A#[xX]([0-9A-Fa-f]+)\z", 1)
        number = F.when(code != "", code.cast("int")).when(digits != "", F.conv(digits, 16, 10).cast("int"))
        usable = (number > 0) & (number < 1114112) & ~number.between(55296, 57343)
        found = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        found = F.when(name.startswith("#"), found).otherwise(F.element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>"), name))
        for known in reversed(USUAL):
            found = F.when(name == known, F.lit(NAMED[known])).otherwise(found)
        return found

    def piece(part: Column, at: Column) -> Column:
        def read(name: Column) -> Column:
            rest = F.substring(part, F.length(name) + 2, F.length(part))
            return F.coalesce(F.concat(character(name), rest), F.concat(F.lit("&"), part))

        return F.when(at == 0, part).otherwise(let(F.regexp_extract(part, REFERENCE, 1), read))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def _settled(text: Column) -> Column:
    """White space collapsed, no blank lines, nothing around the text."""
    return F.btrim(_replaced(text, COLLAPSE), F.lit(" \n"))


def plain_text(shown: Column) -> Column:
    """HTML whose hidden parts are gone, as plain text."""
    return _settled(_references(_replaced(shown, TAGS)))


def _link(value: Column) -> Column:
    """A link as it stands in a tag, on one line."""
    read = _references(F.regexp_replace(value, F.lit(QUOTES), F.lit("")))
    return F.replace(F.btrim(F.regexp_replace(read, F.lit(LINE_PARTS), F.lit("")), F.lit(" ")), F.lit(" "), F.lit("%20"))


def _uuid(name: Column) -> Column:
    digest = F.md5(name)
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Fetched pages as response rows; ``page_id`` is kept."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(CRLF * 2),
    )
    name = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    return pages.select(
        "page_id", _uuid(name).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(head, html).alias("http"),
    )


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines, each ended."""
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs])


def derivatives(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows a response: the columns ``keep``, then the record's headers, block and digests."""
    keep = keep or []
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = found.select(*[F.col(c).alias(f"_kept_{c}") for c in keep], *[text(c).alias(f"_{c}") for c in ("record_id", "target_uri", "date", "http")])
    split = F.instr("_http", CRLF * 2)
    parsed = source.withColumn("_head", F.when(split > 0, F.substring(F.col("_http"), F.lit(1), split - 1)).otherwise("")).withColumn(
        "_body", F.when(split > 0, F.substring(F.col("_http"), split + 4, F.length("_http"))).otherwise(F.col("_http"))
    )
    is_html = F.rlike(F.col("_head"), F.lit(HTML_TYPE)) | (F.col("_head") == "")
    read = (
        parsed.withColumn("_shown", _replaced(F.col("_body"), [(HIDDEN, "")]))
        .withColumn("_text", F.when(is_html, plain_text(F.col("_shown"))).otherwise(F.col("_body")))
        .withColumn("_conversion", _uuid(F.concat(F.lit("conversion|"), F.col("_record_id"))))
        .withColumn("_block_digest", _sha256(F.col("_http")))
        .withColumn("_payload_digest", _sha256(F.col("_body")))
    )
    title = _settled(_references(F.regexp_extract("_body", TITLE, 1)))
    each = lambda values, name: F.concat_ws("", F.transform(values, lambda v: F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))))
    headers = F.filter(F.split(F.col("_head"), CRLF), lambda line: line != "")
    links = F.transform(F.regexp_extract_all("_shown", F.lit(HREF), F.lit(1)), _link)
    fields = F.concat(
        _fields(
            ("source-record-id", F.col("_record_id")), ("source-target-uri", F.col("_target_uri")), ("source-date", F.col("_date")),
            ("source-block-digest", F.col("_block_digest")), ("source-payload-digest", F.col("_payload_digest")),
        ),
        each(headers, "source-http"), _fields(("title", title), ("conversion", F.col("_conversion"))), each(links, "outlink"),
    )
    records = F.array(
        F.struct(F.lit("metadata").alias("type"), _uuid(F.concat(F.lit("metadata|"), F.col("_record_id"))).alias("id"),
                 F.lit("application/warc-fields").alias("kind"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("_conversion").alias("id"),
                 F.lit("text/plain; charset=utf-8").alias("kind"), F.col("_text").alias("block")),
    )
    sources = [f"_{c}" for c in ("record_id", "target_uri", "date", "block_digest", "payload_digest")]
    rows = read.select(*[f"_kept_{c}" for c in keep], *sources, F.explode(records).alias("_r")).withColumn(
        "_digest", _sha256(F.col("_r.block"))
    )
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _fields(
            ("WARC-Type", F.col("_r.type")), ("WARC-Record-ID", F.col("_r.id")), ("WARC-Refers-To", F.col("_record_id")),
            ("WARC-Refers-To-Target-URI", F.col("_target_uri")), ("WARC-Refers-To-Date", F.col("_date")),
            ("WARC-Target-URI", F.col("_target_uri")), ("WARC-Date", F.col("_date")), ("WARC-Block-Digest", F.col("_digest")),
            ("Content-Type", F.col("_r.kind")), ("Content-Length", F.octet_length("_r.block").cast("string")),
        ),
    )
    return rows.select(
        *[F.col(f"_kept_{c}").alias(c) for c in keep],
        F.col("_r.type").alias("warc_type"), F.col("_r.id").alias("record_id"), F.col("_record_id").alias("refers_to"),
        F.col("_target_uri").alias("target_uri"), F.col("_block_digest").alias("source_block_digest"),
        F.col("_payload_digest").alias("source_payload_digest"), F.col("_digest").alias("block_digest"),
        F.octet_length("_r.block").cast("bigint").alias("content_length"), header.alias("header"), F.col("_r.block").alias("block"),
    )


def write_warcs(records: DataFrame, path: str) -> None:
    """WARC files, one for each task, compressed; records follow each other as the format wants."""
    # The line end that the text writer puts after each row is the last character of the record.
    record = F.concat(F.col("header"), F.lit(CRLF), F.col("block"), F.lit("\r\n\r"))
    records.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
