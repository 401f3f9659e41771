import hashlib
import html
import json
import random
import time
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import html_wrappers, transport_stream, warc
from tests.llm.plain import clashing, documents, sha

PAGE = "page_id long, url string, html string"


def page(n, host="a.example"):
    r = random.Random(n)
    p = lambda: " ".join(r.choice(["lorem", "ipsum", "dolor &amp; sit", "amet<b>bold</b>", "x\n y"]) for _ in range(r.randint(1, 30)))
    body = [p() for _ in range(r.randint(0, 6))]
    article = "<h1>Title &eacute; " + str(n) + "</h1>" + "".join(f"<p>{t}" + ("</p>" if r.random() < 0.7 else "") for t in body)
    text = [f"Title é {n}", *[" ".join(html.unescape(re.sub("<[^>]*>", "", t)).split()) for t in body]]
    noise = f'<nav><ul><li><a href="/1">Menu {n}</a><li>Two</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>'
    comments = '<section id="comments"><article class="comment"><p>First!</p></article></section>'
    full = f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header>{noise}<article>{article}</article>{comments}<form><p>Sign up</p></form><footer>&copy; {host}</footer>'
    return full + ("</body></html>" if n % 3 else ""), "\n".join(t for t in text if t)


def test_main_text(spark):
    rows, want = [], {}
    for n in range(40):
        full, text = page(n)
        rows.append((n, f"http://a.example/{n}" if n % 5 else f"https://b{n % 3}.example:80/x", full))
        want[n] = text
    plain = "<html><body><div class=menu><a href=x>Home page of this</a></div><div><p>Only block</p>tail</div></body></html>"
    rows += [(100, "http://c.example/1", plain), (101, None, None), (102, "::bad", ""), (103, "http://d.example/", "no tags &lt;at&gt; all"), (104, "http://e.example/", "<article><p>open <b")]
    want |= {100: "Only block\ntail", 101: "", 102: "", 103: "no tags <at> all", 104: "open"}
    df = clashing(spark.createDataFrame(rows + [rows[0], (None, "http://a.example/", rows[1][2])], PAGE))
    got = html_wrappers.main_text(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = want[1 if r.page_id is None else r.page_id]
        assert (r.text, r.n_chars) == (text, len(text)), r.page_id
    assert html_wrappers.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_wrappers_merge_pages(spark):
    a = html_wrappers.fold(html_wrappers.parse("<div><h2>x</h2><p>1</p><h2>y</h2><p>2</p></div>"))
    b = html_wrappers.fold(html_wrappers.parse("<div><p>0</p></div><hr><p>same</p>"))
    assert a[0][3][0][:2] == ["()", 1]  # a tandem repeat
    both = html_wrappers.align(a, b)
    labels = [(i[0], i[2]) for i in both]
    assert labels == [("div", 0), ("p", 1)]
    c = html_wrappers.align(html_wrappers.fold(html_wrappers.parse("<p>same</p>")), html_wrappers.fold(html_wrappers.parse("<p>same</p>")))
    assert c[0][3][0][4] == [2, 8, 0, "same"]


def test_copies_of_a_page_are_no_boilerplate(spark):
    """Constant means on half of a host's distinct pages, three at least, however often a page is repeated."""
    plain = lambda *blocks: "<html><body>" + "".join(f"<div class={c}>{t}</div>" for c, t in blocks) + "</body></html>"
    rows = [(k, "http://copies.example/", plain(("x", "The one page"))) for k in range(6)]
    many = [plain(("top", "Our site"), ("x", f"Text {k}"), *([("y", "Said thrice")] if k < 3 else [])) for k in range(100)]
    rows += [(100 + k, f"http://many.example/{k}", page) for k, page in enumerate(many)]
    got = {r.page_id: r.text for r in html_wrappers.main_text(spark.createDataFrame(rows, PAGE).repartition(5)).collect()}
    assert [got[k] for k in range(6)] == ["The one page"] * 6
    assert [got[100 + k] for k in range(100)] == [f"Text {k}" + ("\nSaid thrice" if k < 3 else "") for k in range(100)]


@pytest.mark.parametrize("before, after", [("<body class='has-sidebar'>", ""), ("<body><div id='page-with-comments'>", "</div>"), ("<body class=main><div id=main><div class='header-fixed'>", "</div></div>"), ("<body><div class='post no-menu'>", "</div>")])
def test_words_around_the_article_do_not_count(before, after):
    noise = "<div class=sidebar><p>Side</p><div class=content>More</div></div><section class=comments><article><p>First!</p></article></section>"
    page = f"<html>{before}<div class=menu>Menu</div><article class=with-share><h1>Title</h1><p>Text</p><div class=share>Share</div></article>{noise}{after}</body></html>"
    assert html_wrappers.extract(page, html_wrappers.verdicts(html_wrappers.fold(html_wrappers.parse(page)))) == "Title\nText"


def test_deep_and_long_pages():
    deep = "<div>" * 200 + "x" + "</div>" * 200
    assert list(html_wrappers.leaves(html_wrappers.parse(deep)))[0][1] == "x"
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    judged = html_wrappers.verdicts(html_wrappers.fold(html_wrappers.parse(long)))
    assert html_wrappers.extract(long, judged).count("\n") == 19_999


def test_slots_decide_where_names_mean_nothing(spark):
    """Pages of one host without any telling tag or word: own text, its amount and its place in the wrapper tell the article."""
    r, rows, want = random.Random(12), [], {}
    words = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr".split()) for _ in range(n))
    for k in range(30):
        blocks = [words(r.randint(4, 8)), *[words(r.randint(20, 60)) for _ in range(r.randint(1, 6))]]
        links = "".join(f"<li><a href=/{i}>{words(2)}</a>" for i in range(6))
        rows.append((k, f"http://plain.example/{k}", f"<div class=qa><ul>{links}</ul></div><div class=qb>Our house, since 1999</div><div class=qc>{words(6)}</div><div class=qd><h2>{blocks[0]}</h2>" + "".join(f"<p>{b}" for b in blocks[1:]) + f"<div class=qe>Tell it to your friends</div></div><div class=qf>{words(7)}</div>"))
        want[k] = "\n".join(blocks)
    got = {x.page_id: x.text for x in html_wrappers.main_text(spark.createDataFrame(rows, PAGE).repartition(4)).collect()}
    assert got == want
    alone = html_wrappers.extract(rows[0][2], ({}, {}))
    assert alone != want[0]  # without the wrapper there is nothing to go by


def test_hostile_pages():
    """Time and memory that grow with the page: deep nesting, quotes without an end, tags without an end, long unlike lists."""
    text = lambda page: "\n".join(t for _, t in html_wrappers.leaves(html_wrappers.parse(page)))
    start = time.perf_counter()
    deep = "<div>" * 100_000 + "deep" + "</div>" * 50_000 + "half" + "</div>" * 50_000 + "out"
    assert text(deep) == "deep\nhalf\nout"
    assert html_wrappers.extract(deep, html_wrappers.verdicts(html_wrappers.fold(html_wrappers.parse(deep)))) == "deep\nhalf\nout"
    json.loads(json.dumps(html_wrappers.fold(html_wrappers.parse(deep))))
    assert text("<center>" * 50_000 + "<p>" * 3 + "x" + "<center>" * 50_000 + "y") == "x\ny"
    assert text("a" + '<a "' * 100_000 + "z") == "a"
    assert text("a" + '<a href="' * 50_001 + "z > b") == "a b"
    assert text("b <i title='" + "x" * 200_000 + "> c") == "b c"
    assert text("a < b <1 && c <") == "a < b <1 && c <"
    assert text('<p title="a > b" data-x=\'<q>\' class=c>in</p>out<!-- <p>no --><br/>side') == "in\nout side"
    r = random.Random(1)
    long = [html_wrappers.fold(html_wrappers.parse("".join(f"<x{r.randint(0, 30)}>t" for _ in range(0)) + "".join(f"<{t}>t</{t}>" for t in (r.choice("abcdefgh") + r.choice("klmnop") + "x" for _ in range(3000))))) for _ in range(2)]
    both = html_wrappers.align(*long)
    assert sum(slot[1] for _, slot in html_wrappers.slots(both)) == 6000
    assert time.perf_counter() - start < 30


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["div", "p", "h2", "ul", "x"]), max_size=12), st.lists(st.sampled_from(["div", "p", "h2", "ul", "x"]), max_size=12), st.sampled_from([0, 40_000]))
def test_alignment_loses_nothing(one, two, cells):
    """All text of both pages is in the expression that covers them, and matches rise, by either way of aligning."""
    known, html_wrappers.CELLS = html_wrappers.CELLS, cells
    try:
        pairs = html_wrappers._matches(one, two)
        assert all(one[i] == two[j] for i, j in pairs) and all(a < b and c < d for (a, c), (b, d) in zip(pairs, pairs[1:]))
        a, b = (html_wrappers.fold(html_wrappers.parse("".join(f"<{t}>{t}{k}</{t}>" for k, t in enumerate(x)))) for x in (one, two))
        assert sum(s[0] for _, s in html_wrappers.slots(html_wrappers.align(a, b))) == len(one) + len(two)
    finally:
        html_wrappers.CELLS = known


# --- media --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 150, 162, 163, 164, 176, 184, 185, 8191, 8192, 8193, 50_000])
def test_stream_round_trip(n):
    data = transport_stream.payload_of(random.Random(n).randbytes(n))
    media = transport_stream.mux(data)
    read = transport_stream.demux(media)
    assert read["samples"] == data and len(media) % 188 == 0
    assert read["units"] == -(-len(data) // transport_stream.UNIT) == len(read["access"])
    assert read["timestamps"] == [k * transport_stream.UNIT * 90_000 // transport_stream.SAMPLE_RATE for k in range(read["units"])]


def test_damaged_streams():
    media = transport_stream.mux(b"x" * 6400)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    broken = {"synchronisation": b"\0" + media[1:], "continuity": b"".join(packets[:5] + packets[6:]), "CRC": media[:10] + b"\x55" + media[11:], "map table": b"".join(packets[:1] + packets[2:]), "whole number": media[:-1]}
    for what, data in broken.items():
        with pytest.raises(ValueError, match=what):
            transport_stream.demux(data)
    with pytest.raises(ValueError, match="more than twice"):
        transport_stream.demux(b"".join(packets[:5] + packets[4:5] * 2 + packets[5:]))
    with pytest.raises(ValueError, match="damaged"):
        transport_stream.demux(b"".join(packets[:4] + [packets[4][:1] + bytes([packets[4][1] | 0x80]) + packets[4][2:]] + packets[5:]))
    assert transport_stream.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_legal_streams_of_other_writers():
    """Packets sent twice, packets without a payload, empty packets, and tables that span packets."""
    data = random.Random(2).randbytes(20_032)
    media = transport_stream.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    want = transport_stream.demux(media)
    bare = lambda p, flags=0: bytes([0x47, p[1] & 0x1F, p[2], 0x20 | (p[3] - 1) & 15, 183, flags]) + b"\xff" * 182
    empty = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    mixed = []
    for k, p in enumerate(packets):
        mixed += [empty] * (k % 5 == 0) + [bare(p)] * (k > 2 and k % 3 == 0) + [p] + [p] * (k % 4 == 0)
    assert transport_stream.demux(b"".join(mixed)) == want
    # a random-access point told by the packet before
    moved = [p if k < 3 or not p[1] & 0x40 else p[:5] + bytes([p[5] & ~0x40]) + p[6:] for k, p in enumerate(packets)]
    assert transport_stream.demux(b"".join(moved))["access"] == want["access"][:1] != want["access"]
    told = [x for k, p in enumerate(moved) for x in ([bare(p, 0x40)] if k >= 2 and packets[k][1] & 0x40 else []) + [p]]
    assert transport_stream.demux(b"".join(told))["access"] == want["access"]
    # the same program map table in two packets, after the end of another section
    section = transport_stream._read_section(np.frombuffer(packets[1], np.uint8).reshape(1, 188), np.array([0x100]), 0x100, "x")
    fill = 184 - 1 - 5 - 10
    first = bytes([0x47, 0x41, 0x00, 0x30, fill, 0]) + b"\xff" * (fill - 1) + bytes([5]) + b"tail!" + section[:9]
    second = (bytes([0x47, 0x01, 0x00, 0x11]) + section[9:]).ljust(188, b"\xff")
    assert len(first) == 188 and transport_stream.demux(b"".join([packets[0], first, second, *packets[2:]])) == want


def test_media_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 20_000), (5, "héllo"), (None, "n"), (1, "héllo")]
    got = transport_stream.media_columns(clashing(documents(spark, rows)), with_media=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(data) and r.payload_sha256 == sha(transport_stream.payload_of(data))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert r.timestamps == [k * transport_stream.UNIT * 90_000 // transport_stream.SAMPLE_RATE for k in range(len(r.access_points))] and r.access_points == list(range(0, r.payload_bytes, transport_stream.UNIT))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 5)}) == 1
    assert transport_stream.media_columns(documents(spark, [])).count() == 0


# --- WARC ---------------------------------------------------------------------------------------------------------------------


def test_records_round_trip():
    block = warc.http_message("200 OK", [("A", "1"), ("a", "2"), ("B", "x: y")], b"body\r\n\r\nmore")
    for compress in (False, True):
        data = warc.write_record("response", {"WARC-Target-URI": "http://x/"}, block, compress)
        [(fields, got)] = list(warc.read_records(data))
        assert got == block and fields["warc-type"] == "response"
    status, headers, body = warc.read_http(block)
    assert (status, headers["a"], headers["b"], body) == (200, "1, 2", "x: y", b"body\r\n\r\nmore")
    both = warc.write_record("response", {}, block) + warc.write_record("revisit", {}, b"")
    assert [f["warc-type"] for f, _ in warc.read_records(both)] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.read_records(both[:-9]))


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2", "http://u:p@example.com/a/?a=1&b=2&ref=z", None]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(__import__("pyspark").sql.functions.col("u")).alias("c")).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + [None]


def test_resolution_against_plain(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICES", (10, 50))
    r = random.Random(6)
    rows = []
    for k in range(300):
        kind = r.choice(["response", "revisit", "revisit"])
        url = r.choice(["http://h.example/hot"] * 4 + [f"http://h.example/{r.randint(0, 9)}", None])
        headers = {h: str(r.randint(0, 1)) for h in ("etag", "last-modified", "date", "server") if r.random() < 0.7}
        rows.append((k, f"r{k:03d}", kind, r.randint(0, 400) if r.random() < 0.95 else None, url, r.choice([200, 200, 404]) if kind == "response" else 304, headers, f"b{k}", k, r.choice([None, f"r{r.randint(0, 99):03d}"])))
    rows += [(301, "r301", "revisit", 5, "http://nowhere/", 304, {}, "", 0, None)]
    got = {x.record_id: x for x in warc.resolve(spark.createDataFrame(rows, warc.CAPTURE)).collect()}
    assert len(got) == sum(x[2] == "revisit" for x in rows)
    for page_id, number, kind, time, url, _, headers, _, _, named in rows:
        if kind != "revisit":
            continue
        x = got[number]
        earlier = [y for y in rows if url and time is not None and y[3] is not None and y[2] == "response" and y[5] == 200 and y[4] == url and (y[3], y[1]) < (time, number)]
        assert x.page_id == page_id
        if url is None or time is None:
            assert (x.verdict, x.refers_to, x.as_named) == ("no url" if url is None else "no date", None, None)
            continue
        if not earlier:
            assert x.verdict == "no earlier response" and x.refers_to is None
            continue
        of = max(earlier, key=lambda y: (y[3], y[1]))
        test = next((h for h in ("etag", "last-modified") if h in headers and h in of[6]), None)
        verdict = "no validator" if test is None else "resolved" if headers[test] == of[6][test] else "validator mismatch"
        assert (x.verdict, x.refers_to, x.as_named) == (verdict, of[1], None if named is None else named == of[1])
        if verdict == "resolved":
            merged = {**of[6], **{h: v for h, v in headers.items() if h in warc.UPDATES}}
            assert x.headers == "\n".join(f"{k}: {v}" for k, v in sorted(merged.items())) and x.body_sha256 == of[7]
    assert warc.resolve(spark.createDataFrame([], warc.CAPTURE)).count() == 0


def test_standard_fields():
    for time in (0, 1_700_000_000_000_000, 1_700_000_000_123_456):
        assert warc.read_date(warc.warc_date(time)) == time
    assert warc.warc_date(1_700_000_000_000_000) == "2023-11-14T22:13:20Z"
    assert warc.read_date("2023-11-14T23:13:20+01:00") == warc.read_date("2023-11-14T22:13:20") == 1_700_000_000_000_000
    assert warc.read_date(None) is None and warc.read_date("yesterday") is None
    fields = warc.record_fields("a", 0, "http://x/", warc.NOT_MODIFIED, ("b", "http://x/", 7))
    [(read, _)] = list(warc.read_records(warc.write_record("revisit", fields, b"HTTP/1.1 304 Not Modified\r\n\r\n")))
    assert {k.lower(): v for k, v in fields.items()}.items() <= read.items() and set(fields) == {"WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Profile", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"}


def test_captures_of_other_records(spark):
    """Records of other kinds and profiles are passed over; those without a date or name stay, as the docstring says."""
    ok, not_modified = warc.http_message("200 OK", [("ETag", "1")], b"b"), warc.http_message("304 Not Modified", [("ETag", "1")])
    data = [
        warc.write_record("warcinfo", {}, b"software: x") + warc.write_record("response", {"WARC-Target-URI": "http://x/", "WARC-Date": "2023-01-01T00:00:00Z", "WARC-Record-ID": "<urn:a>"}, ok, False),
        warc.write_record("revisit", {"WARC-Target-URI": "http://x/", "WARC-Date": "2023-01-02T00:00:00Z", "WARC-Profile": warc.NOT_MODIFIED}, not_modified, True),
        warc.write_record("revisit", {"WARC-Target-URI": "http://x/", "WARC-Profile": warc.NOT_MODIFIED}, not_modified),
        warc.write_record("revisit", {"WARC-Target-URI": "http://x/", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, not_modified),
        b"",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(data)), "page_id long, data binary")
    got = {r.page_id: (r.verdict, r.refers_to) for r in warc.resolve(warc.captures(rows)).collect()}
    assert got == {1: ("resolved", "<urn:a>"), 2: ("no date", None)}


def test_captures_of_pages(spark):
    pages = spark.createDataFrame([(n, f"http://h.example/{n}#x" if n != 4 else None, f"<p>{n}</p>" if n != 6 else None) for n in range(14)] + [(None, "http://h.example/0", "none")], PAGE)
    resolved = warc.resolve(warc.captures(warc.records_of_pages(clashing(pages)))).collect()
    got = {r.page_id: r for r in resolved if r.url != "hot.example/robots.txt"}
    robots = [r for r in resolved if r.url == "hot.example/robots.txt"]
    assert len(got) == 15 and sum(r.verdict == "resolved" for r in robots) >= 4 and {r.page_id for r in robots} >= {3, 6, 9, 12}
    want = {1: "validator mismatch", 2: "no earlier response", 3: "no validator"}
    for n in range(14):
        assert got[n].verdict == ("no url" if n == 4 else want.get(n % 7, "resolved"))
        assert got[n].as_named is (None if n in (2, 4, 9) else True)
    assert got[6].body_sha256 == sha("") and got[0].body_sha256 == sha("<p>0</p>")
