import base64
import gzip
import hashlib
import random

import pytest

from textloom.llm import html_extract as H
from textloom.llm import warc as W
from textloom.llm._common import scratch_table


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, first long")


def test_round_trip(spark):
    rng = random.Random(4)
    big = "<p>" + "é漢 word " * 20_000 + "</p>"
    rows = [(i, f"http://h{i % 3}.example/{i}", rng.choice(["short", "same " * 40, "x" * 99, "y" * 100, big, None, "", "a\r\n0\r\n\r\nb" * 30])) for i in range(60)] + [(5, None, "again " * 30), (5, None, "again " * 30)]
    archives = scratch_table(W.write_archives(pages(spark, rows), segment_bytes=5000, archive_bytes=1_500), "t")
    assert archives.count() > 1
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"], r["complete"]) for r in W.read_archives(archives).collect())
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = len(b) >= 100 and first[h or ""] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if other else "response", first[h or ""] if other else -1, True))
    assert got == sorted(want)
    assert W.read_archives(scratch_table(W.write_archives(pages(spark, rows).limit(0)), "t")).collect() == []


def test_records_are_plain_warc():
    out = b"".join(W.page_records("0-1", 7, "http://a.example/", b"z" * 9000, hashlib.sha256(b"z" * 9000).hexdigest(), None, 4000))
    text = gzip.decompress(out)
    assert text.count(b"WARC/1.0\r\n") == 3 and text.count(b"WARC-Type: continuation") == 2 and text.count(b"WARC-Segment-Total-Length") == 1
    assert len(list(W.records(out))) == len(list(W.records(text))) == 3


def test_revisits_are_resolved_against_what_was_read(spark):
    rows = pages(spark, [(3, None, "same " * 40), (1, None, "same " * 40), (2, None, "same " * 40), (2, None, "other " * 40), (2, None, "other " * 40), (4, None, "other " * 40)])
    archives = [r["content"] for r in W.write_archives(rows).collect()]
    told = [h for c in archives for h, _ in W.records(c) if h["warc-type"] in ("response", "revisit")]
    ids = [h["warc-record-id"] for h in told]
    assert len(set(ids)) == len(ids) == 6 and {h["warc-refers-to"] for h in told if h["warc-type"] == "revisit"} <= set(ids)
    assert all("warc-payload-length" not in h for h in told)
    # The response of one payload is lost, that of the other is damaged.
    lost = [b"".join(m for m in W.members(c) if not (b"WARC-Type: response" in m and b"same" in m)).replace(b"other other", b"other 0ther") for c in archives]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or -1, r["payload_bytes"] or -1, r["complete"]) for r in W.read_archives(spark.createDataFrame([("a", c) for c in lost], "name string, content binary")).collect())
    assert got == [(2, "response", -1, 240, False)] * 2 + [(2, "revisit", -1, -1, False), (3, "revisit", -1, -1, False), (4, "revisit", 2, 240, False)]


def test_missing_segment_is_told(spark):
    parts = list(W.page_records("0-1", 7, None, b"z" * 9000, hashlib.sha256(b"z" * 9000).hexdigest(), None, 4000))
    rows = spark.createDataFrame([("a", b"".join(parts[:2])), ("b", b"".join(W.page_records("0-2", 8, None, b"ok", hashlib.sha256(b"ok").hexdigest(), None, 4000)))], "name string, content binary")
    got = {r["page_id"]: r["complete"] for r in W.read_archives(rows).collect()}
    assert got == {7: False, 8: True}
    # Segments in several archives, out of order, come together.
    split = spark.createDataFrame([("a", parts[2] + parts[0]), ("b", parts[1])], "name string, content binary")
    assert [(r["payload_bytes"], r["complete"]) for r in W.read_archives(split).collect()] == [(9000, True)]


def foreign(headers, block, length=True):
    """A record as another writer would leave it: no page id, identifiers of its own."""
    told = [("WARC-Date", "2021-01-01T00:00:00Z"), *headers, *([("Content-Length", len(block))] if length else [])]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told).encode() + b"\r\n" + block + b"\r\n\r\n"


def read(spark, *contents):
    rows = W.read_archives(spark.createDataFrame([(str(k), c) for k, c in enumerate(contents)], "name string, content binary")).collect()
    return sorted((r["url"] or "", r["record_type"], -1 if r["payload_bytes"] is None else r["payload_bytes"], r["complete"]) for r in rows)


def test_archives_of_other_writers(spark):
    body = b"<p>plain</p>" * 20
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    one = lambda url, kind, name, *more: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", url), *more]
    parts = [
        foreign(one("", "warcinfo", "0"), b"software: other\r\n"),
        foreign(one("a", "request", "1"), b"GET / HTTP/1.1\r\n\r\n"),
        foreign(one("b", "response", "2", ("WARC-Payload-Digest", sha1)), http),
        foreign(one("c", "response", "3", ("WARC-Payload-Digest", "sha1:" + "A" * 32)), http),
        foreign(one("d", "response", "4", ("WARC-Payload-Digest", "blake3:00")), http),
        foreign(one("e", "response", "5", ("Content-Type", "text/dns")), b"dns answer"),
        foreign(one("f", "revisit", "6", ("WARC-Refers-To", "<urn:uuid:2>"), ("WARC-Payload-Digest", sha1)), b"HTTP/1.1 200 OK\r\n\r\n"),
        foreign(one("g", "revisit", "7", ("WARC-Payload-Digest", sha1)), b""),
        foreign(one("h", "response", "8"), http, length=False),
        foreign([("WARC-Type", "response"), ("WARC-Target-URI", "i\xe9")], b"no header"),
        foreign(one("j", "request", "9", ("WARC-Segment-Number", 1)), b"GET"),
        foreign([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:uuid:10>"), ("WARC-Segment-Origin-ID", "<urn:uuid:9>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", 6)], b" /\r"),
        foreign(one("k", "response", "11", ("WARC-Segment-Number", "first")), http),
    ]
    n = len(body)
    want = [("b", "response", n, True), ("c", "response", n, False), ("d", "response", n, True), ("e", "response", 10, True), ("f", "revisit", n, True), ("g", "revisit", -1, False), ("h", "response", n, False), ("i\xe9", "response", -1, False), ("k", "response", n, False)]
    assert read(spark, b"".join(parts)) == read(spark, b"".join(map(gzip.compress, parts))) == want
    assert read(spark, None, b"", b"\r\n") == []


def test_damaged_archives_are_read_as_far_as_they_go(spark):
    pages_of = lambda k: b"".join(W.page_records(f"0-{k}", k, f"u{k}", b"z" * 500, hashlib.sha256(b"z" * 500).hexdigest(), None, 4000))
    a, b, c = pages_of(1), pages_of(-2), pages_of(3)
    good = [("u-2", "response", 500, True), ("u1", "response", 500, True), ("u3", "response", 500, True)]
    assert read(spark, a + b + c) == good
    # A member that is not gzip any more, one stretch of garbage, an archive that is none.
    assert read(spark, a + b[:10] + b"\xff" * (len(b) - 10) + c) == [("", "damaged", -1, False), good[1], good[2]]
    assert read(spark, a + b"garbage" + c) == [("", "damaged", -1, False), good[1], good[2]]
    assert read(spark, b"no archive at all") == read(spark, b"\x1f\x8b\x08 none") == [("", "damaged", -1, False)]
    # Cut off anywhere: never a crash, the first page always whole, nothing cut called complete.
    plain = gzip.decompress(a + b)
    one = len(gzip.decompress(a))
    for cut in (len(a) + 1, len(a) + 40, len(a) + len(b) // 2, len(a) + len(b) - 12):
        assert [r for r in read(spark, (a + b)[:cut]) if r[3]] in ([good[1]], good[:2])
    for cut in range(one + 1, len(plain) - 4, 97):
        assert [r for r in read(spark, plain[:cut]) if r[3]] == [good[1]]
    # A length that is too short leaves the rest of the block over.
    assert [r[1:] for r in read(spark, plain.replace(b"Content-Length: ", b"Content-Length: 1\r\nX: ", 1))] == [("damaged", -1, False), ("response", 500, True), ("response", -1, False)]
    # A segment that is cut off, and one whose first part is gone.
    parts = list(W.page_records("0-9", 9, "u9", b"z" * 9000, hashlib.sha256(b"z" * 9000).hexdigest(), None, 4000))
    assert [r[3] for r in read(spark, b"".join(parts))] == [True]
    assert [r[3] for r in read(spark, gzip.decompress(b"".join(parts))[:-200])] == [False]
    assert [r[3] for r in read(spark, b"".join(parts[1:]))] == [False]


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunks(size):
    for payload in (b"", b"a", b"0\r\n\r\n" * 50):
        assert W.dechunked(W.chunked(payload, size)) == payload


FULL = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p>First   <b>bold</b>
line<br>on.<p>Second &lt;tag&gt; &#233;&nbsp;end<div class="ad-slot">Buy now</div><ul><li>one<li>two</ul><aside>Side</aside><form><input><button>Go</button></form></article>
<section id="comments"><article class="comment"><p>Reader says</p></article></section><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.example/1", FULL), (2, "http://a.example/2", FULL.replace("First", "Another")), (3, None, None), (4, "http://b.example/", ""), (5, "bad url", "plain words only"), (6, "http://a.example/6", FULL[: FULL.index("<ul><li>one")])]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert got[1] == "Head & line\nFirst bold line on.\nSecond <tag> é end\none\ntwo"
    assert got[2] == got[1].replace("First", "Another")
    assert got[3] == got[4] == "" and got[5] == "plain words only"
    assert got[6] == "Head & line\nFirst bold line on.\nSecond <tag> é end"
    assert H.extract(pages(spark, rows).limit(0)).collect() == []


def test_slots_that_never_change_go(spark):
    page = "<html><body><div class='top'>Every page says this</div><div class='x'><p>Body {0} of the page</p></div></body></html>"
    rows = [(i, f"http://c.example/{i}", page.format(f"number {i}")) for i in range(6)]
    assert {r["text"] for r in H.extract(pages(spark, rows)).collect()} == {f"Body number {i} of the page" for i in range(6)}
    same = [(i, f"http://d.example/{i}", page.format("alike")) for i in range(6)]
    assert {r["text"] for r in H.extract(pages(spark, same)).collect()} == {"Every page says this\nBody alike of the page"}


def test_texts_that_differ_stay_beside_one_that_never_changes(spark):
    page = "<html><body><div><p>Every page says this</p><p>Body {0} of the page</p><p>{1}</p></div></body></html>"
    rows = [(i, f"http://f.example/{i}", page.format(f"number {i}", "On most" if i else "On one")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Body number {i} of the page\n{'On most' if i else 'On one'}" for i in range(6)}


def test_running_text_outweighs_names_and_lists_of_references_stay(spark):
    say = lambda k, what: f"On day {k} the members met again and spoke of {what} until {k + 3} o'clock in the evening without a vote."
    lists = lambda k: "".join(f"<li><a href=/r{k}{j}>Paper {k}{j}</a>" for j in range(5))
    inside = (
        "<html><body><article><p>{0}</p><div class='ad-hoc'><p>{1}</p></div><section class='newsletter-history'><p>{2}</p></section><div id='comments-on-policy'><p>{3}</p></div>"
        "<div class='ad-top'>Buy {4}</div><div class='cookie-note-box'>We use {4}</div><div class='user-comments'><p>{5}</p></div></article><div id='comments-on-site'><p>{5}</p></div></body></html>"
    )
    plain = "<html><body><div><ul>" + "<li><a href=/>Part</a>" * 4 + "</ul></div><div><h1>Day {4}</h1><p>{0}</p><p>{1}</p><h2>Read {4}</h2><ul>{6}</ul></div><div><ul>{6}</ul></div></body></html>"
    told = [[say(k, w) for w in ("roads", "a committee", "letters", "rules")] + [str(k), say(k, "nothing"), lists(k)] for k in range(10, 18)]
    rows = [(k, f"http://a.example/{k}", inside.format(*t)) for k, t in enumerate(told)] + [(100 + k, f"http://b.example/{k}", plain.format(*t)) for k, t in enumerate(told)]
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract(pages(spark, rows)).collect()}
    for k, t in enumerate(told):
        assert got[k] == t[:4]
        assert got[100 + k] == [f"Day {t[4]}", *t[:2], f"Read {t[4]}", *(f"Paper {t[4]}{j}" for j in range(5))]


def shape(w):
    return [w[0], w[1], [shape(c) for c in w[2]]]


def test_wrappers_stay_union_free():
    a = H.skeleton(H.parse("<div><h1>x</h1><p>a</p><p>b</p></div>"), 1)
    b = H.skeleton(H.parse("<div><p>a</p><table><tr><td>q</td></tr></table></div>"), 2)
    want = ["root", "1", [["div.~blocks", "1", [["h1", "?", [["#", "1", []]]], ["p", "+", [["#", "1", []]]], ["table", "?", [["tr", "1", [["td", "1", [["#", "1", []]]]]]]]]]]]
    assert shape(H.merged(a, b)) == want and shape(H.merged(H.merged(a, b), a)) == want
    # Sums do not depend on the order of merging; a page met twice counts as one.
    assert H.merged(a, b)[3] == H.merged(b, a)[3] and H.merged(a, a)[3][:2] == [1, 6]
    # The expression accepts children in its order only.
    places = H.Places(H.merged(a, b)[2][0])
    taken = [places.take(H.Node(t)) for t in ("p", "p", "h1", "table", "ul")]
    assert [x and x[0] for x in taken] == ["p", "p", None, "table", None]


def plain_site(rng, host, n):
    """Pages without telling tags or names: (url, html, texts of the story)."""
    word = lambda k: " ".join(rng.choices("stone river light order buyer crate total week north glass paper field".split(), k=k)).capitalize()
    out = []
    for i in range(n):
        menu = "".join(f"<a href='/{k}'>{word(2)}</a></div><div>" for k in range(5))
        story = [word(rng.randint(3, 8)), *(word(rng.randint(15, 60)) + "." for _ in range(rng.randint(2, 7)))]
        more = "".join(f"<li><a href='/{k}'>{word(4)}</a></li>" for k in range(rng.randint(3, 6)))
        body = "".join(f"<p>{x}</p>" for x in story[1:])
        out.append((f"http://{host}/{i}", f"<html><body><div class=a1><div>{menu}</div></div><div class=a2>Read by many</div><div class=a3><h2>{story[0]}</h2>{body}</div><ul class=a4>{more}</ul><div class=a5>All rights with the makers of {host}</div></body></html>", story))
    return out


def test_the_wrapper_decides(spark):
    rng = random.Random(9)
    told = [x for h in ("one.example", "two.example") for x in plain_site(rng, h, 12)]
    got = {r["page_id"]: r["text"].split("\n") for r in H.extract(pages(spark, [(i, u, h) for i, (u, h, _) in enumerate(told)])).collect()}
    right = sum(len(set(got[i]) & set(story)) for i, (_, _, story) in enumerate(told))
    assert 2 * right / (sum(map(len, got.values())) + sum(len(s) for _, _, s in told)) >= 0.95
    alone = {i: H.blocks(H.parse(h), None) for i, (_, h, _) in enumerate(told)}
    assert all(alone[i] != got[i] and "Read by many" in alone[i] for i in alone)
    # A page judged by the wrapper of its host, and by that of one where what stands in that place varies.
    first = [h for _, h, _ in told[:3]]
    other = [h.replace("Read by many", f"Lead {k}") for k, h in enumerate(first)]
    w = [H.merged(H.skeleton(H.parse(x), 1), H.merged(H.skeleton(H.parse(y), 2), H.skeleton(H.parse(z), 3))) for x, y, z in (first, other)]
    assert H.blocks(H.parse(first[0]), w[0]) == told[0][2] and H.blocks(H.parse(first[0]), w[1]) == ["Read by many", *told[0][2]]


def test_names_that_only_hint_do_not_decide():
    article = "<body><article><div class='related-work'><p>Others have shown this before.</p></div><div class='reply-brief'>The brief says no to it all.</div><div class='side-note'>Mind the gap between them.</div><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><div class='related-posts'><a href=/>One more</a></div></article></body>"
    assert H.blocks(H.parse(article), None) == ["Others have shown this before.", "The brief says no to it all.", "Mind the gap between them.", "As x=2 holds."]
    main = "<main><p>" + "The story runs on here. " * 9 + "</p><article>A teaser</article></main>"
    assert len(H.blocks(H.parse(main), None)) == 2
    assert H.blocks(H.parse("<div class='layout has-sidebar'><div class='sidebar-left'>x</div><article>Kept</article></div>"), None) == ["Kept"]


def test_depth_changes_nothing():
    for depth in (0, 10, 118, 3000):
        page = "<article>" + "<div>" * depth + "<nav>menu</nav><p>text</p>" + "</div>" * depth + "</article>"
        assert H.blocks(H.parse(page), None) == ["text"]


def test_partial_wrappers_are_merged_in_rounds(spark):
    rng = random.Random(2)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(plain_site(rng, "hot.example", 90))]
    for fan_in in (2, 7):
        (w,) = H.wrappers(pages(spark, rows).repartition(15), fan_in=fan_in).collect()
        whole = None
        for _, _, h in rows:
            form = H.skeleton(H.parse(h), H.hashed(h))
            whole = H.merged(whole, form) if whole else form
        import json

        got = json.loads(w["wrapper"])
        assert shape(got) == shape(whole) and got[3] == whole[3]


def test_deep_and_long_pages(spark):
    deep = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>after</p></article><footer>foot</footer>"
    long = "<article>" + "<h2>head</h2><p>text</p>" * 4000 + "</article>"
    rows = [(1, "http://e.example/1", deep), (2, "http://e.example/2", long), (3, "http://e.example/3", "<div" * 4000), (4, "http://e.example/4", "<p title=\"open>x")]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows)).collect()}
    assert got[1] == "deep\nafter" and got[2] == "\n".join(["head", "text"] * 4000) and len(got) == 4


def test_whole_pages_of_the_small_table(spark, small):
    from textloom.llm.queries import op7_html_extract

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op7_html_extract(spark, small).collect():
        article = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        import html
        import re

        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", part))).strip() for part in re.split(r"</?(?:p|h\d)>", article)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])
