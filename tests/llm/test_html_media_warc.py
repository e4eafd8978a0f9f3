import base64
import hashlib
import io
import random
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmark.llm import html_text, media, warc_zip
from gridmark.llm.queries import op9_media

LONG = "This is a sentence of the article, with commas, and it goes on for a while. " * 4
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div><aside><p>{LONG}</p></aside>
<article><h1>Head &amp; line</h1><p>First {LONG}<p>Second&nbsp;{LONG}<br>more <b>bold</b><i>er</i>
<div class="ad">Buy</div><form><p>{LONG}</p></form><script>var a = "</p><p>no";</script><!-- <p>gone</p> --><ul><li>one<li>two</ul></article>
<section id="comments"><p>{LONG}</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    want = ["Head & line", "First " + LONG.strip(), "Second " + LONG.strip() + " more bolder", "one", "two"]
    assert html_text.content(PAGE) == "\n".join(want)


def test_page_without_an_article_element():
    html = f"<body><div class=x><a href=1>a</a> <a href=2>b</a></div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div id=footer>f</div></body>"
    assert html_text.content(html) == "\n".join(["Title", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div id="page" class="site sticky-header">', '<div class="post social-sharing-on">', "<div><div role=search>"])
def test_a_marked_wrapper_does_not_hide_the_article(wrapper):
    ad = f'<div class="ad">Buy</div><div class="sidebar"><p>{LONG}</p></div>'
    for inside in (f"<article><p>{LONG}</p><p>{LONG}</p></article>", f"<h2>Head</h2><p>{LONG}</p><p>{LONG}</p>", f"<p>{LONG}</p><p>{LONG}</p>", f"<h1 class=header>Head</h1><p>{LONG}</p><p>{LONG}</p>", f"<main><div class=share><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></main>"):
        want = ["Head"] * ("Head" in inside) + [LONG.strip()] * inside.count("<p>")
        assert html_text.content(f"<body>{wrapper}{ad}{inside}</div></body>") == "\n".join(want)
    assert html_text.content(f"<body><div class=ad>{LONG}</div><article><h1>Short</h1><p>Text</p></article></body>") == "Short\nText"
    forum = f"<body><div class=comment><p>{LONG}</p></div><div class=comment><p>{LONG}</p></div></body>"
    assert html_text.content(forum).count(LONG.strip()) == 2


def test_blocks_of_content_paths_outside_the_holder_stay():
    a, b, c = (f"{x} {LONG}".strip() for x in "abc")
    assert html_text.content(f"<body><main><h1>T</h1><p>{a}</p><article><h2>H</h2><p>{b}</p><p>{c}</p></article></main></body>") == "\n".join(["T", a, "H", b, c])
    two = "".join(f"<article><h2>{x[0]}</h2><p>{x}</p></article>" for x in (a + b + c, b))
    assert html_text.content(f"<body>{two}</body>") == "\n".join(["a", a + b + c, "b", b])
    lead = f"<body><div id=content><h1>T</h1><p class=lead>{a}</p><div class=body>{f'<p>{b}</p>' * 12}</div></div><div>Menu</div></body>"
    assert html_text.content(lead) == "\n".join(["T", a, *[b] * 12])
    section = lambda n: f"<section><h2>S</h2><p>{a}</p><ul><li>one</ul>{f'<p>{b}</p>' * n}</section>"
    assert html_text.content(f"<body>{section(20)}<div>{section(0)}</div></body>") == "\n".join(["S", a, "one", *[b] * 20, "S", a, "one"])


def test_links_stay_inside_an_article():
    links = "<p><a href=x>A reference alone</a></p><ul><li><a href=y>Another reference</a></ul>"
    html = f"<body><article><p>{LONG}</p>{links}</article><div>{links}</div></body>"
    assert html_text.content(html) == "\n".join([LONG.strip(), "A reference alone", "Another reference"])


@pytest.mark.parametrize("html", ["", "<", "<p", "<script>", "<!--", "<p class='", "</p></p>", "<a><b><c>", "plain", "<p>x<script>y", "&amp;&bogus;&#0;"])
def test_broken_pages(html):
    assert isinstance(html_text.content(html), str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/p abdiv\"'=&;!-", max_size=200))
def test_any_markup(html):
    html_text.content(html)
    media.pieces(html)


def test_many_unclosed_elements_are_quick():
    assert html_text.content("<p>word " * 20_000).startswith("word\nword")


HUGE = {
    "bare": "<" * 2_000_000, "tags without an end": "a <b " * 400_000, "quotes without an end": "<a x=\"y>" * 150_000 + "text", "single quotes": "<a x='>\" " * 200_000, "mixed": "<p class='a\">x" * 150_000,
    "deep": "<div>x" * 150_000, "closers": "<div>" * 100_000 + "</p>" * 100_000 + "x", "marks": "<div class=ad>x" * 100_000, "spans": "<span class=ad>x" * 100_000, "scripts": "<script>x</script" * 100_000,
    "comments": "<!--" * 300_000, "declarations": "<!x" * 300_000, "cdata": "<![CDATA[" * 100_000, "references": "&#" + "9" * 1_000_000 + "; &" * 100_000, "equals": "<a " + "= " * 500_000 + ">x",
}


@pytest.mark.parametrize("name", sorted(HUGE))
def test_broken_pages_of_megabytes_are_quick(name):
    began = time.time()
    html_text.content(HUGE[name])
    media.pieces(HUGE[name])
    assert time.time() - began < 15


def test_bare_signs_are_quick():
    began = time.time()
    html_text.content("<" * 2_000_000)
    assert time.time() - began < 2


CONTENT_NAMES = ["related-work", "legal-history", "reply-rate", "copyright-law", "ad-spend", "post", "lead", "shared-values", "menu-engineering", "story"]
PARTS = ['<nav><a href=/>x</a></nav>', '<div class="ad">{0}</div>', '<div class="ad-slot"><p>{0}</p></div>', '<aside><p>{0}</p></aside>', '<div class="sidebar widget">{0}</div>', '<form><input><p>{0}</p></form>', '<script>{0}</script>', '<section class="comment-list"><h3>c</h3><p>{0}</p></section>', '<div id="cookie-notice">{0}</div>', '<footer><p>{0}</p></footer>', '<header><p>{0}</p></header>', '<!-- {0} -->']


def test_generated_pages_give_their_articles():
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rng.randint(4, 14))).capitalize() + rng.choice([".", ", and so on.", "!"])
    for n in range(200):
        blocks, body = [f"Title {n}"], [f"<h1>Title {n}</h1>"]
        for _ in range(rng.randint(3, 12)):
            text = " ".join(sentence() for _ in range(rng.randint(1, 5)))
            kind, mark = rng.randrange(7), rng.choice(CONTENT_NAMES)
            if kind == 0:
                body.append(f"<p><a href=x>{text}</a></p>")
            elif kind == 1:
                body.append(f'<ul class="{mark}"><li><a href=y>{text}</a></ul>')
            elif kind == 2:
                body.append(f'<div class="{mark}">{text}</div>')
            elif kind == 3:
                body.append(f'<section id="{rng.choice([mark, "legal"])}"><p>{text}</section>')
            elif kind == 4:
                body.append(f'<table class="{mark}"><tr><td>{text}</table>')
            else:
                body.append(f"<p class={mark}>{text}</p>" if kind == 5 else f"<p>{text}")
            blocks.append(text)
            if rng.random() < 0.4:
                body.append(rng.choice(PARTS).format("Furniture " + sentence()))
        frame = ["".join(rng.choice(PARTS).format("Furniture " + sentence()) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        article = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article class=post>{}</article></main>", '<div class="layout has-sidebar"><article>{}</article></div>'])
        assert html_text.content(f"<html><body>{frame[0]}{article.format(''.join(body))}{frame[1]}</body></html>") == "\n".join(blocks)


def test_ratios_equal_a_plain_count():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randint(1, 30)
        paths, lengths, marks = ([rng.randint(0, k) for _ in range(n)] for k in (4, 300, 9))
        mean = lambda values, i: sum(v for v, p in zip(values, paths) if p == paths[i]) / paths.count(paths[i])
        smooth = lambda values, i: sum(w * mean(values, i + d) for d, w in ((-1, 1), (0, 2), (1, 1)) if 0 <= i + d < n) / sum(w for d, w in ((-1, 1), (0, 2), (1, 1)) if 0 <= i + d < n)
        want = [smooth(lengths, i) * (1 + smooth(marks, i)) for i in range(n)]
        assert html_text.fused(paths, lengths, marks) == pytest.approx(want)


def test_link_share_is_of_the_path():
    html = f"<body><div id=text><p>{LONG}</p><p>{LONG}</p><p><a href=x>One paragraph that is a link</a></p><p>{LONG}</p></div><div id=more><ul><li><a href=1>menu</a><li><a href=2>menu</a></ul></div></body>"
    assert html_text.content(html).split("\n") == [LONG.strip(), LONG.strip(), "One paragraph that is a link", LONG.strip()]


def test_comment_section_with_a_title_goes():
    html = f"<body><article><h1>T</h1><p>{LONG}</p></article><section id=comments><h2>Comments</h2><p>{LONG}</p></section><form action=x><div><p>{LONG}</p></div></form></body>"
    assert html_text.content(html) == f"T\n{LONG.strip()}"
    around = f"<body><form action=x><article><h1>T</h1><p>{LONG}</p></article></form></body>"
    assert html_text.content(around) == f"T\n{LONG.strip()}"


def test_html_column(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, text string")
    out = [r[0] for r in df.select(html_text.main_text("html")).collect()]
    assert out[0] == out[1] != "" and out[2] == ""
    assert df.limit(0).select(html_text.main_text("html")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % media.ROW == 0 and len(payload) >= media.ROW
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_damaged_png():
    image = bytearray(media.to_png(media.padded(b"abc" * 500)))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


def test_pieces_stay_in_order(spark):
    html = '<p>a</p><figure><img src="sha256:%s" alt="alt"><figcaption>cap <b>tion</b></figcaption></figure><p>b<img src=x alt=y>c</p>' % ("0" * 64)
    df = spark.createDataFrame([(1, html, "z"), (2, None, None)], "doc_id long, html string, caption2 string")
    table = spark.createDataFrame([("0" * 64, 5)], "digest string, payload_bytes long")
    out = media.resolve(df.withColumn("p", media.sequence("html")), "p", table).orderBy("doc_id", "position").collect()
    assert [(r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"]) for r in out] == [
        (0, "text", "a", None, None), (1, "image", None, "cap tion", 5), (2, "text", "b", None, None), (3, "image", None, "y", None), (4, "text", "c", None, None),
    ]


def slow_feature(payload):
    bins, half = [0] * 8, max(1, len(payload) // 576 // 2) * 576
    for b in payload:
        bins[b // 32] += 1
    return "h:" + ",".join(str(n * 10_000 // len(payload)) for n in bins) + ";m:" + ",".join(str(sum(x) * 100 // max(1, len(x))) for x in (payload[:half], payload[half:]))


def opened(image):
    """Samples of a PNG, read by the published format apart from the operator."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    head = chunks[0][1]
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert head[8:] == bytes([8, 0, 0, 0, 0])
    raw, out, above = zlib.decompress(chunks[1][1]), b"", bytes(width)
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        assert line[0] in (0, 2)
        row = line[1:] if line[0] == 0 else bytes((a + b) & 255 for a, b in zip(line[1:], above))
        out, above = out + row, row
    return width, height, out


@pytest.mark.parametrize("raw", [b"", b"a" * 576, b"b" * 577, bytes(range(256)) * 20])
def test_images_open_in_an_independent_reader(raw):
    payload = media.padded(raw)
    assert opened(media.to_png(payload)) == (576, len(payload) // 576, payload)


def test_columns_may_clash_with_pieces_and_media(spark):
    df = spark.createDataFrame([(1, '<p>a</p><img src="sha256:%s">' % ("1" * 64), "t", 7, "r", "k")], "doc_id long, html string, text string, payload_bytes int, ref string, key string")
    table = spark.createDataFrame([("1" * 64, 5, "x")], "digest string, payload_bytes long, row string")
    out = media.resolve(df.withColumn("p", media.sequence("html")), "p", table)
    assert len(set(out.columns)) == len(out.columns)
    assert sorted((r["position"], r["doc_id"], r["key"], r["text"], r["payload_bytes"], r["row"]) for r in out.collect()) == [(0, 1, "k", "a", None, None), (1, 1, "k", None, 5, "x")]


def test_pieces_give_the_text_back_in_order():
    rng = random.Random(3)
    words = ["a", "b & c", "<i>", "x > y", "&amp;", "é\u00a0ü", '"q"', "z = \"1", "日本"]
    for _ in range(50):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        escaped = [x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for x in lines]
        html = "".join(f'<p>{x}</p><img src="{i}" alt="c{i}">' for i, x in enumerate(escaped))
        found = media.pieces(html)
        assert [p["text"] for p in found if p["kind"] == "text"] == lines
        assert [(p["position"], p["ref"], p["caption"]) for p in found if p["kind"] != "text"] == [(2 * i + 1, str(i), f"c{i}") for i in range(len(lines))]


def test_media_query(spark, tmp_path):
    rows = [(7, "one & <b>\ntwo\x0b x\r\n\n three  four\n5\n6"), (8, "a\n" * 700), (1, "a" * 576), (2, ""), (None, None), (4, "é" * 5000), (4, "é" * 5000), (5, "a" * 577)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op9_media(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    texts = {d: (t or "") for d, t in rows}
    for r in out:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.strip()]
        assert r["in_order"] and r["position"] == 1 + len(lines) // 2 and r["n_pieces"] == 2 + len(lines)
        image = media.to_png(payload)
        assert r["media_bytes"] == len(image) and r["feature"] == slow_feature(payload)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op9_media(spark, str(tmp_path / "none")).count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw, self.asked = raw, 0

    def size(self):
        return len(self.raw)

    def read_at(self, length, offset):
        self.asked += length
        return self.raw[offset : offset + length]


def test_archive_reader_agrees_with_zipfile():
    records = [(str(i), warc_zip.record(i, f"http://x/{i}", b"p" * i, None, False)) for i in range(50)]
    raw = warc_zip.pack(records)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        whole = z.read(warc_zip.DATA)
    archive = warc_zip.Archive(Bytes(raw))
    start, size = archive.start(warc_zip.DATA), archive.members[warc_zip.DATA][1]
    assert raw[start : start + size] == whole
    assert list(archive.records()) == [r for _, r in records]


def test_zip64_end_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:  # more members than the short count holds
        for i in range(65_600):
            z.writestr(f"m{i}", b"")
        z.writestr(warc_zip.DATA, b"data")
        z.comment = b"PK\x05\x06 no end record"
    archive = warc_zip.Archive(Bytes(out.getvalue()))
    assert len(archive.members) == 65_601
    start = archive.start(warc_zip.DATA)
    assert out.getvalue()[start : start + 4] == b"data"
    with pytest.raises(ValueError):
        warc_zip.Archive(Bytes(b"no archive"))


def test_records_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}\n", rng.choice(["", "same", "é" * 100, "x" * 50_000, f"own {i}"])) for i in range(60)] + [(None, None, None), (3, "u", "again"), (3, "u", "again"), (None, "v", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(5)
    manifest = warc_zip.write(df)
    got = sorted(map(tuple, warc_zip.read_back(manifest).collect()), key=repr)
    newest = {}
    for page, _, html in rows:
        if page is not None:
            newest[html or ""] = max(newest.get(html or "", page), page)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = []
    for page, _, html in rows:
        h = html or ""
        revisit = page != newest[h]
        want.append((page, len(h.encode()), digest(h), "revisit" if revisit else "response", newest[h] if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc_zip.read_back(warc_zip.write(df.limit(0))).count() == 0


def test_column_names_may_clash(spark):
    df = spark.createDataFrame([("k", "<p>x</p>")], "html_text string, html string").withColumn("pieces", F.lit(1))
    assert df.withColumn("text", html_text.main_text("html")).first()["text"] == "x"


SENTENCES = [f"Sentence {k} of the story goes on, with a comma, for quite a while and ends here." for k in range(12)]
STORY = "".join(f"<p>{s}</p>" for s in SENTENCES)
WANT = SENTENCES
USUAL = {
    "heading in the article's header": ("<article><header><h1>Big Title</h1><p>By A. Writer</p></header>{}</article>", ["Big Title", "By A. Writer", *WANT]),
    "comments as articles": ('<article><h1>T</h1>{}</article><section id="comments"><h2>3 comments</h2>' + '<article class="comment"><p>I say this, at length, and more.</p></article>' * 3 + "</section>", ["T", *WANT]),
    "comments inside the article": ('<article><h1>T</h1>{}<section id="comments"><h2>3 comments</h2><article class="comment" id="comment-12"><h3>Me</h3><p>I say this, at length, and much more, again and again.</p></article></section></article>', ["T", *WANT]),
    "comments in a list": ('<main><h1>T</h1>{}<ol class="replies"><li>I say this, at length, and more.</li></ol></main>', ["T", *WANT]),
    "notices": ('<article><div class="notice"><p>We have changed our terms, so read them, please, before you go on.</p></div>{}<div class="banner">Sale, sale, sale!</div><div id="login-box"><p>Log in, or sign up, to read on.</p></div><p class="copyright">(c) us, all rights reserved.</p></article>', WANT),
    "marked sentences of the story": ('<article>{}<p class="promo">This sentence is of the story too, and it is as long as the others are.</p><section class="social"><p>People talked about it, in every street, for as long as they could.</p></section></article>', [*WANT, "This sentence is of the story too, and it is as long as the others are.", "People talked about it, in every street, for as long as they could."]),
    "short marked lines": ('<article>{}<p class="promo">Buy now</p><div class="social">Follow</div></article>', WANT),
    "a side column without a known class": ('<body><div class="rail"><p>More here</p><p>And there</p><p>Top ten</p></div><div class="story"><h2>Head</h2>{}</div></body>', ["Head", *WANT]),
    "a long notice": ('<body><div class="cookie-consent"><p>' + " ".join(SENTENCES * 3) + "</p></div><div>{}</div></body>", WANT),
    "a side column that holds articles": ("<body><aside><article><h3>Other</h3><p>Another story, of which only this stands here.</p></article></aside><article><h1>T</h1>{}</article></body>", ["T", *WANT]),
    "site header with a title": ("<body><header><h1>The Site</h1><p>News, every day, for all of you.</p></header><div><h2>Head</h2>{}</div></body>", ["Head", *WANT]),
}


@pytest.mark.parametrize("name", USUAL)
def test_usual_markup(name):
    html, want = USUAL[name]
    assert html_text.content(html.replace("{}", STORY)) == "\n".join(want)


def plainly_chosen(page, share):
    """Content blocks, by the definitions alone: ratios by path, smoothed and fused, against the share of the best."""
    keys = [(page.paths[e], w) for e, _, _, w in page.blocks]
    long = [len(t) - link for _, t, link, _ in page.blocks]
    marks = [sum(c in ".,;:!?…。，、！？" for c in t) for _, t, _, _ in page.blocks]
    mean = lambda values, i: sum(v for v, k in zip(values, keys) if k == keys[i]) / keys.count(keys[i])
    means = [(mean(long, i), mean(marks, i)) for i in range(len(keys))]
    around = lambda i: [(means[i + d], 2 - abs(d)) for d in (-1, 0, 1) if 0 <= i + d < len(keys)]
    smooth = lambda i, k: sum(m[k] * w for m, w in around(i)) / sum(w for _, w in around(i))
    score = [smooth(i, 0) * (1 + smooth(i, 1)) for i in range(len(keys))]
    free = max(w for _, w in keys)
    top = max(s for s, (_, w) in zip(score, keys) if w == free)
    at = {k: max(s for s, o in zip(score, keys) if o == k) for k in set(keys)}
    return {i for i, k in enumerate(keys) if min(at[k], top) * (k[1] / free) >= share * top}


def generated(rng, article):
    line = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta.", "of", "the"]) for _ in range(n))
    parts = []
    for _ in range(rng.randint(4, 25)):
        kind = rng.randrange(9)
        parts.append([f"<p>{line(rng.randint(8, 60))}</p>", f"<h2>{line(3)}</h2>", f"<div class=c{rng.randrange(3)}><p>{line(rng.randint(1, 9))}</p></div>", f"<ul><li>{line(4)}<li>{line(2)}</ul>", f'<div class="ad">{line(9)}</div>', f"<aside><p>{line(20)}</p></aside>", f"<blockquote><p>{line(12)}</p></blockquote>", f'<p class="promo">{line(rng.randint(1, 30))}</p>', f"<table><tr><td>{line(1)}<td>{line(2)}</table>"][kind])
    body = "".join(parts)
    return f"<html><body><nav><a href=/>x</a></nav><div class=rail><p>{line(3)}</p></div>{f'<article>{body}</article>' if article else f'<div>{body}</div>'}<footer>{line(5)}</footer></body></html>"


def test_selection_is_that_of_the_ratios(monkeypatch):
    import pyarrow.parquet as pq

    rng = random.Random(3)
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() + [generated(rng, k % 2) for k in range(200)]
    texts = {}
    for share in (0.15, 0.0, 0.9):
        monkeypatch.setattr(html_text, "SHARE", share)
        for i, html in enumerate(pages):
            page = html_text.parsed(html)
            if page.blocks and (share == 0.15 or i >= len(pages) - 200):
                assert html_text.chosen(page) == plainly_chosen(page, share)
        texts[share] = [html_text.content(html) for html in pages]
    differ = lambda a, b: sum(x != y for x, y in zip(texts[a], texts[b], strict=True))
    assert differ(0.15, 0.0) >= len(pages) * 0.9 and differ(0.15, 0.9) >= 40


def test_articles_of_the_test_pages():
    """Every page of the table: exactly the blocks of its article."""
    import re

    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        if html and len(found := re.findall(r"(?s)<article>(.*)</article>", html)) == 1:
            alone = html_text.parsed(f"<article>{found[0]}</article>")
            assert html_text.content(html).replace("\n", " ") == " ".join(text for _, text, _, weight in alone.blocks if weight == 1)
