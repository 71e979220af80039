from __future__ import annotations

import glob
import gzip
import hashlib

from thriftline.llm import warc

HTML = (
    '<!DOCTYPE html><html><head><title> A &amp;lt; B\n</title><style>p{x:"</p>"}</style></head><body><!-- no <b>way</b> -->'
    '<script>var t="</p>";</script><h1 class="a > b">Top</h1><p>One&nbsp;two <b>bold</b>&#233;&#x41;&nosuch;&eacute;<br/>next'
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><a class=x href='/p?q=1'>l</a> <a href=\"bad link\">m</a> 1 < 2</body></html>"
)


def build(spark, rows):
    df = spark.createDataFrame([(*r, "kept") for r in rows], "record_id string, target_uri string, date string, http string, block string")
    return {(r.refers_to, r.warc_type): r for r in warc.derivatives(df).collect()}


def test_text_links_and_headers(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n" + HTML
    rows = [("<urn:1>", "http://a", "2020", http), ("<urn:2>", None, None, None), ("<urn:3>", "u", "d", "<p>x<script>never ends <p>y")]
    rows += [("<urn:4>", "u", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n<b> stays"), ("<urn:5>", "u", "d", "<p>w</p>" * 200000)]
    found = build(spark, rows)
    assert len(found) == 10
    text, meta = found["<urn:1>", "conversion"], found["<urn:1>", "metadata"]
    assert text.block == "Top\nOne two boldéA&nosuch;é\nnext\na\nb\nc\nd\nl m 1 < 2"
    assert f"source-payload-digest: sha256:{hashlib.sha256(HTML.encode()).hexdigest()}\r\n" in meta.block
    assert f"source-block-digest: sha256:{hashlib.sha256(http.encode()).hexdigest()}\r\n" in meta.block
    assert "source-http: HTTP/1.1 200 OK\r\nsource-http: Content-Type: text/html\r\nsource-http: X-A: b\r\n" in meta.block
    assert "title: A &lt; B\r\n" in meta.block and "outlink: /p?q=1\r\noutlink: bad%20link\r\n" in meta.block
    assert f"conversion: {text.record_id}\r\n" in meta.block
    for r in found.values():
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and r.content_length == len(r.block.encode())
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.block_digest in r.header
    assert found["<urn:2>", "conversion"].block == "" and found["<urn:3>", "conversion"].block == "x"
    assert found["<urn:4>", "conversion"].block == "<b> stays"
    assert found["<urn:5>", "conversion"].block == "\n".join(["w"] * 200000)


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, "http://x", "<p>a"), (1, "http://x", "<p>a"), (None, None, None), (2, "", "")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, block string, type int")
    found = warc.derivatives(warc.responses(pages), ["page_id"]).collect()
    assert len(found) == 8 and len({r.record_id for r in found}) == 6
    assert warc.derivatives(warc.responses(pages.limit(0)), ["page_id"]).count() == 0


def test_files_hold_records_one_after_the_other(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>é{i}\n\n") for i in range(7)], "page_id bigint, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    warc.write_warcs(made, str(tmp_path / "out"))
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/*.gz")))
    read = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        length = int(head.split(b"Content-Length: ")[1])
        read.append((head.decode() + "\r\n", rest[:length].decode()))
        assert rest[length : length + 4] == b"\r\n\r\n"
        data = rest[length + 4 :]
    assert sorted(read) == sorted((r.header, r.block) for r in made.collect())


def test_left_out_tags_types_references_and_links(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\nX-From: /index.html\r\n\r\n"
    literal = "if a <b and c> d: keep <this> literal"
    rows = [
        ("<1>", "<head><title>t</title><body><p>visible text <a href=x.html>l</a>"),
        ("<2>", head.format("text/plain") + literal),
        ("<3>", head.format("text/html; charset=utf-8") + "<HEAD lang=en><META x><style>p</style><p>&#x27;&#X41;&Eacute;&hearts;&#xD800;&#x;&bogus;&rarr"),
        ("<4>", head.format("application/xhtml+xml") + "<p>x</p>"),
        ("<5>", "<a title=q href='a b&amp;c'>1</a><a\nHREF = \" /x&#10;y \">2</a><a href=''>3</a><abbr href=no>4</abbr>"),
        ("<6>", "HTTP/1.1 200 OK\r\n\r\n" + literal),
    ]
    found = build(spark, [(i, "u", "d", h) for i, h in rows])
    assert found["<1>", "conversion"].block == "visible text l"
    assert "title: t\r\n" in found["<1>", "metadata"].block and "outlink: x.html\r\n" in found["<1>", "metadata"].block
    assert found["<2>", "conversion"].block == found["<6>", "conversion"].block == literal
    assert found["<3>", "conversion"].block == "'AÉ♥&#xD800;&#x;&bogus;&rarr"
    assert found["<4>", "conversion"].block == "x"
    links = [v for v in found["<5>", "metadata"].block.split("\r\n") if v.startswith("outlink")]
    assert links == ["outlink: a%20b&c", "outlink: /xy", "outlink: "]


def test_the_twin_reads_the_same_pages(spark):
    import duckdb

    from thriftline.llm import queries

    html = [HTML, "<head><title>t &#x41;</title><p>&Eacute;&#x2019;&#65;&#x0;&nope;<a href=q w>l</a>", "<a href='x &quot;y'>m", None, "", "&;&#;&#x;&amp"]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    made = warc.derivatives(warc.responses(pages), ["page_id"])
    db = duckdb.connect()
    frame = pages.toPandas()  # noqa: F841
    db.execute("CREATE VIEW pages AS SELECT * FROM frame")
    want = db.sql(queries._derivatives()).fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want)
