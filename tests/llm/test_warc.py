"""WARC derivatives: exact round trips and damaged records."""

import gzip
import time
import zlib

import pytest

from touchline.llm import warc


def test_derivatives_link_to_their_response(spark):
    html = "<html><head><title>t</title></head><body><h1>Hello &amp; bye</h1><p>one  two<script>x()</script></p><a href='/n'>next</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.com/\r\nX: y", html, 5), (2, None, None, 5), (3, "http://b.de/", "", 5), (3, "http://b.de/", "", 5)], "page_id bigint, url string, html string, id int")
    records = {r["page_id"]: bytes(r["record"]) for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8
    for r in rows:
        headers, block = warc.parse(records[r["page_id"]])
        own, content = warc.parse(bytes(r["record"]))
        assert own["warc-refers-to"] == r["refers_to"] == headers["warc-record-id"] and own["warc-type"] == r["kind"] and own["warc-date"] == headers["warc-date"]
        assert r["source_block_digest"] == warc.digest(block) and r["source_payload_digest"] == headers["warc-payload-digest"]
        assert content == bytes(r["block"]) and r["block_digest"] == warc.digest(content) and r["target_uri"] == headers["warc-target-uri"]
        assert {h["name"]: h["value"] for h in r["source_headers"]}["Content-Type"] == "text/html; charset=utf-8"
    first = {r["kind"]: bytes(r["block"]).decode() for r in rows if r["page_id"] == 1}
    assert first["conversion"] == "Hello & bye\none two\nnext" and "outlink: /n" in first["metadata"] and "source-status: HTTP/1.1 200 OK" in first["metadata"]
    assert warc.derivatives(warc.responses(pages.filter("false"))).count() == 0


def test_null_and_damaged_records(spark):
    good = warc.response("http://a.com/", "<p>x</p>")
    bad = [None, b"", good[:-20], good.replace(b"<p>x", b"<p>y"), good.replace(b"WARC-Type: response", b"WARC-Type: request"), b"junk"]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate([*bad, good])], "page_id int, record binary")
    kinds = [r["kind"] for r in sorted(warc.derivatives(df).collect(), key=lambda r: r["page_id"])]
    assert kinds[:6] == ["null", "null", "damaged", "damaged", "damaged", "damaged"] and sorted(kinds[6:]) == ["conversion", "metadata"]


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><p>Hello", "Hello"), ("<head><meta x='1'><p>No end of the head</p>", "No end of the head"), ("<noscript>Turn it on<p>rest of the page", "Turn it on\nrest of the page"),
    ("a<noscript>b<p>c</noscript>d", "a\nd"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"), ("1 < 2 &amp; 3 <b>x</b>y", "1 < 2 & 3 xy"), ("a<!-- <p>b --><p>c<!-- d", "a\nc"), ("x<script>if (a<b) '</p>'</SCRIPT >y", "xy"),
    ("<a title='x > y' href=\"/q\">l</a>", "l"), ("a</ b>c<?php x?>d<![CDATA[e]]>f", "acdf"), ("x<p", "x"), ("İ<SCRIPT>a</script>b", "İb"), ("<title>only", ""), ("", ""), ("<", ""), ("a<p class=x\"y>b", "a\nb"),
])
def test_text_of_pages(html, text):
    assert warc.html_text(html)[0] == text


def test_links_of_pages():
    assert warc.html_text("<a href=/a>1</a><A class=x HREF='b?x=1&amp;y=2'>2</A><a name=z>3</a><a href=''>4</a><a data-x='1' href = \"c\">")[1] == ["/a", "b?x=1&y=2", "c"]


@pytest.mark.parametrize("piece", ["<a ", "<p>", "<a href='", "<!--", "</", "<noscript>", "<script>", "&#", "<td", '<a b="', "<![CDATA[", "< ", "<template><title>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.time()
    warc.html_text(piece * 100_000)
    assert time.time() - began < 5


def test_codings_digests_and_ids():
    page = b"<p>Hello <b>there</b></p>"

    def made(body, *fields, **head):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body
        named = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a.b/"} | {k.replace("_", "-"): v for k, v in head.items()}
        return warc.record([(k, v) for k, v in named.items() if v], block)

    chunks = b"5;x=1\r\n" + page[:5] + b"\r\n" + b"%x\r\n" % (len(page) - 5) + page[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    bodies = [(page,), (chunks, b"Transfer-Encoding: chunked"), (gzip.compress(page), b"Content-Encoding: gzip"), (zlib.compress(page), b"Content-Encoding: deflate"), (raw.compress(page) + raw.flush(), b"Content-Encoding: deflate")]
    for body in bodies:
        assert [bytes(r["block"]) for r in warc.derive(made(*body)) if r["kind"] == "conversion"] == [b"Hello there"]
        assert len(warc.derive(made(*body, WARC_Payload_Digest=warc.digest(body[0])))) == 2
    assert len(warc.derive(made(chunks, b"Transfer-Encoding: chunked", WARC_Payload_Digest=warc.digest(page)))) == 2
    assert [r["kind"] for r in warc.derive(made(page, WARC_Payload_Digest=warc.digest(b"other")))] == ["damaged"]
    assert [r["kind"] for r in warc.derive(made(page, WARC_Record_ID=""))] == ["damaged"]


def coded(body, *fields):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body
    return [(r["kind"], bytes(r["block"]).decode() if r["kind"] == "conversion" else "") for r in warc.derive(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)) if r["kind"] != "metadata"]


def test_nothing_of_a_coded_body_is_lost():
    """Members, codings in a row, large bodies: whole; cut, broken, unknown or beyond the bound: damaged."""
    a, b, z = gzip.compress(b"<p>one</p>"), gzip.compress(b"<p>two</p>"), b"Content-Encoding: gzip"
    both, damaged = [("conversion", "one\ntwo")], [("damaged", "")]
    assert coded(a + b, z) == coded(a + b + b"\0" * 20, z) == coded(a + gzip.compress(b"") + b, z) == both
    assert coded(a + b"x", z) == coded(a + b[:-3], z) == coded(a[:15], z) == coded(b"<p>one</p>", z) == damaged
    assert coded(b"", z) == [("conversion", "")] and coded(gzip.compress(b""), z) == [("conversion", "")]
    assert coded(a + b, b"Content-Encoding: GZIP , identity") == coded(gzip.compress(zlib.compress(b"<p>one</p><p>two")), b"Content-Encoding: deflate, gzip") == both
    assert coded(a, b"Content-Encoding: br") == coded(a, b"Content-Encoding: br, gzip") == coded(zlib.compress(b"<p>one")[:-2], b"Content-Encoding: deflate") == damaged
    large = b"<p>" + b"word " * 14_000_000 + b"</p><p>end"
    assert len(large) > 64 << 20 and coded(gzip.compress(large, 1), z)[0][1].endswith("\nend")
    assert warc.unpacked(gzip.compress(b"x" * 1000), ["gzip"], most=1000) == b"x" * 1000 and warc.unpacked(gzip.compress(b"x" * 1001), ["gzip"], most=1000) is None
    assert warc.unpacked(gzip.compress(b"x" * 600) * 2, ["gzip"], most=1000) is None


def test_chunks_are_whole_or_damaged():
    te, whole = b"Transfer-Encoding: chunked", b"5\r\n<p>on\r\n1\r\ne\r\n0\r\n\r\n"
    assert coded(whole, te) == [("conversion", "one")]
    for cut in (whole[:-5], whole[:-9], whole[:9], b"5\r\n<p>on\r\nzz\r\ne\r\n0\r\n\r\n", b"5\r\n<p>one\r\n0\r\n\r\n"):
        assert coded(cut, te) == [("damaged", "")], cut
    assert coded(b"<p>not in chunks", te) == [("conversion", "not in chunks")] and coded(b"", te) == [("conversion", "")]
    packed = gzip.compress(b"<p>one")
    assert coded(b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n", b"Transfer-Encoding: gzip, chunked") == [("conversion", "one")]


def test_query_against_a_plain_reading(spark, sf):
    """Every page gives two records; links, digests and text are those that another parser finds."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.links, self.silent = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.silent += tag in ("script", "style", "head")
            self.words.append(" " if tag in warc.LINES or tag in warc.CELLS else "")
            self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

        def handle_endtag(self, tag):
            self.silent -= tag in ("script", "style", "head")
            self.words.append(" " if tag in warc.LINES or tag in warc.CELLS else "")

        def handle_data(self, data):
            self.words.append("" if self.silent else data)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = warc.op6_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) == len({r["record_id"] for r in rows})
    assert all(r["refers_to"] not in {x["record_id"] for x in rows} for r in rows)
    for r in rows:
        page = pages[r["page_id"]]
        body = (page["html"] or "").encode()
        assert r["target_uri"] == page["url"] and r["source_payload_digest"] == warc.digest(body) and r["block_digest"] == warc.digest(bytes(r["block"]))
        p = Plain()
        p.feed(page["html"] or "")
        p.close()
        block = bytes(r["block"]).decode()
        if r["kind"] == "conversion":
            assert block.split() == "".join(p.words).split()
        else:
            assert [x[9:] for x in block.split("\r\n") if x.startswith("outlink: ")] == p.links
