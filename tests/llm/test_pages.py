import base64
import functools
import hashlib
import html as entities
import json
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from rows import FOLDER

from lanewise.llm import html_extraction, warc
from lanewise.llm.html_tree import parse

FIELDS = "page_id long, url string, html string, text string, host string, record_type string, sha string"


def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


def plain_archive(rows):
    keys = defaultdict(list)
    for key, html in rows:
        keys[html or ""].append(key)
    out = Counter()
    for key, html in rows:
        known = [k for k in keys[html or ""] if k is not None]
        alone = len(keys[html or ""]) == 1 or not known or key == max(known)
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[(key, len(data), digest, "response" if alone else "revisit", None if alone else max(known))] += 1
    return out


TRICKY = [
    (1, "http://a/\r\nWARC", "é" * 1000),
    (2, None, None),
    (3, "x", ""),
    (None, "y", "é" * 1000),
    (None, "z", "alone"),
    (5, "é /", "WARC/1.1\r\nWARC-Archive-ID: x\r\n\r\n\n\r\n\r\n"),
    (5, "é /", "WARC/1.1\r\nWARC-Archive-ID: x\r\n\r\n\n\r\n\r\n"),
    (7, "a", "é" * 1000),
    (8, "q", "日本語😀" * 500),
    (None, None, "日本語😀" * 500),
    (9, "", "\n"),
]


@pytest.mark.parametrize("most", [1 << 16, 100, 5])
def test_archives_hold_what_was_written(spark, most):
    table = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in TRICKY], FIELDS).repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(table, most=most).collect())
    assert got == plain_archive([(k, h) for k, _, h in TRICKY])


def test_archive_of_the_pages(spark):
    got = Counter(tuple(r) for r in warc.round_trip(pages(spark), most=500).collect())
    assert got == plain_archive([(r.page_id, r.html) for r in pages(spark).collect()])
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_not_revisited(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(table, least=3).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


@pytest.mark.parametrize("bits", [8, 1 << 10, 1 << 28])
def test_full_fields_change_no_record(spark, monkeypatch, bits):
    monkeypatch.setattr(warc, "BITMAP_BITS", min(bits, 1 << 15))
    monkeypatch.setattr(warc, "MOST_BITS", bits)
    if bits < 1 << 15:  # Spark's bitmaps have a fixed size: every place is taken in a field this small.
        monkeypatch.setattr(warc, "field_of", lambda marks: marks.sparkSession.sparkContext.broadcast(b"\xff" * (bits // 8)))
    rows = [(i, f"u{i}", "x" * (i % 40) if i % 3 else None) for i in range(300)] + [(5, "v", "x" * 5), (None, None, "xx"), (None, None, "é")]
    table = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert Counter(tuple(r) for r in warc.round_trip(table, most=7).collect()) == plain_archive([(k, h) for k, _, h in rows])


def test_payloads_of_pages_do_not_move(spark, monkeypatch, tmp_path):
    plans = []
    real = DataFrame.mapInArrow

    def seen(df, *told, **more):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, *told, **more)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(DataFrame, "mapInArrow", seen)
        warc.write_archive(pages(spark), f"{tmp_path}/archive", "page_id", "url", "html")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plans = [plan for columns, plan in plans if "payload" in columns]
    assert "html" in plans[0] and not any(name in plans[0] for name in ("Exchange", "Join"))
    assert "html" not in plans[1]


def test_chunks_end_between_characters():
    for text in ("", "a", "éé日本😀" * 30):
        for most in (4, 5, 7, 1000):
            parts = list(warc.chunks(text.encode(), most))
            assert b"".join(parts) == text.encode() and all(len(p) <= most for p in parts)
            assert "".join(p.decode() for p in parts) == text


def test_bytes_that_are_no_text(spark):
    """Parquet strings may hold any bytes, also a long run without the beginning of a character."""
    run = b"\x80" * 1000
    parts = list(warc.chunks(b"ab" + run, 400))
    assert b"".join(parts) == b"ab" + run and all(0 < len(p) <= 400 for p in parts)
    rows = [(1, b"u\xff", run), (2, b"u", b"a\xffb\n"), (3, None, b"a\xffb\n"), (4, b"", b"\xc3")]
    table = spark.createDataFrame(rows, "page_id long, url binary, html binary")
    table = table.selectExpr("page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.round_trip(table, most=300).collect()}
    want = {k: (len(h), warc.base32(hashlib.sha1(h).digest()), 3 if k == 2 else None) for k, _, h in rows}
    assert got == want


def test_records_are_made_one_by_one():
    payload, archive = memoryview(b"payload " * (1 << 20)), "12345678-1234-5678-1234-567812345678"
    tracemalloc.start()
    try:
        sizes = [len(r) for r in warc.page_records(archive, 0, "1", b"u", payload, None, 1 << 16)]
        assert len(sizes) == 128 and tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
    told = hashlib.sha1(payload).hexdigest()
    assert list(warc.page_records(archive, 0, "1", b"u", payload, None, 1 << 16, told)) == list(
        warc.page_records(archive, 0, "1", b"u", bytes(payload), None, 1 << 16)
    )


def test_a_changed_payload_is_noticed():
    row = next(warc.page_records("12345678-1234-5678-1234-567812345678", 0, "1", b"u", b"payload", None, 100))
    line = warc.first_line("12345678-1234-5678-1234-567812345678").encode()
    assert warc.parsed(row[len(line) :] + b"\n")["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parsed(row[len(line) :].replace(b"payload\r", b"Payload\r") + b"\n")
    with pytest.raises(ValueError):
        warc.parsed(row[len(line) :].replace(b"payload\r", b"payloads\r") + b"\n")


def extracted(*texts):
    wrapper = None
    for text in texts:
        page = html_extraction.expression(parse(text))
        wrapper = page if wrapper is None else html_extraction.aligned(wrapper, page)
    told = html_extraction.profile(json.loads(json.dumps(wrapper)))
    return [html_extraction.main_text(t, told) for t in texts]


FULL = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1>
<nav><a href=/>Home</a></nav></header><div id="cookie-banner">We use cookies <button>OK</button></div>
<div class="layout with-sidebar"><main><article class="post"><header><h2>Head %d</h2></header>
<p>First &eacute; para %d <b>bold</b>,   x&nbsp;y &amp;amp; z.</p><aside>related</aside><div class="ad-slot">Buy!</div><ul><li>one<li>two</ul>
<table><tr><td>cell<td>next</table><p hidden>unseen</p><p style="display: none">unseen</p><p>Last<br>line<footer>by me</footer></article>
<section id="comments"><article class="comment"><p>Nice post %d</p></article><form><textarea>x</textarea></form></section>
</main><div class="sidebar"><p>Popular %d</p></div></div><footer>&copy; us</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_articles_without_furniture():
    got = extracted(*[FULL.replace("%d", str(i)) for i in range(3)])
    assert got == [f"Head {i}\nFirst é para {i} bold, x y &amp; z.\none\ntwo\ncell\nnext\nLast line" for i in range(3)]


def test_wrappers_tell_texts_from_templates():
    named = '<body><div id="top"><ul class="menu"><li><a>Home</a></ul></div><div id="content"><h1>T%d</h1><p>Text %d</p><div class="comments">x</div></div></body>'
    assert extracted(*[named.replace("%d", str(i)) for i in range(3)]) == [f"T{i}\nText {i}" for i in range(3)]
    bare = "<body><div><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div><div><p>Text %d</p><p>More %d</p></div><div>All rights reserved</div></body>"
    assert extracted(*[bare.replace("%d", str(i)) for i in range(5)]) == [f"Text {i}\nMore {i}" for i in range(5)]


def test_expressions():
    a = html_extraction.expression(parse("<ul><li>a</li><li>b</li></ul><p>same</p>"))
    b = html_extraction.expression(parse("<ul><li>c</li></ul><h2>x</h2><p>same</p>"))
    ul, h2, p = html_extraction.aligned(a, b)
    assert ul[0] == "ul" and ul[4][0][:3] == ["li", 0, 1] and ul[4][0][4][0][1] is None
    assert h2[:2] == ["h2", 1] and p[:2] == ["p", 0] and p[4][0][1] is not None
    wide = html_extraction.expression(parse("".join(f"<x{i}></x{i}>" for i in "abcdefghijklmnopqrstuvwxyz" for i in (i, i * 2, i * 3))))
    assert len(wide) == html_extraction.WIDEST


LAYOUTS = [
    ("<main><h1>Head %s</h1><p>Lead %s</p><article><p>Text %s</p></article></main>", "Head %s\nLead %s\nText %s"),
    ("<main><p>Text %s</p><p>More %s</p><article class='card'>Teaser</article></main>", "Text %s\nMore %s\nTeaser"),
    ("<article class='card'>Teaser %s</article><main><p>Text %s</p></main><p>By us</p>", "Teaser %s\nText %s"),
    ("<div class='article-intro'>Intro %s</div><p>x</p><div class='article-body'>Long text %s</div>", "Intro %s\nLong text %s"),
    ("<article class='a'>One %s</article><article class='b'>Two %s</article>", "One %s\nTwo %s"),
    ("<main><ul><li><a href=x>Elsewhere %s</a></ul><article><p>Text %s</p><p><a>all %s</a></p></article></main>", "Text %s\nall %s"),
    ("<div class='post'><a href=x>Elsewhere</a></div><div class='story'>Text %s</div>", "Text %s"),
    ("<p>x</p><main><a href=x>Only links %s</a></main>", "Only links %s"),
]


KEPT_NAMES = [
    ("<article><section id='social-history'><h2 id='related-work'>H %s</h2><p class='notice'>N %s</p></section>T %s</article>", "H %s\nN %s\nT %s"),
    ("<article><h2 id='search-methods'>Fixed head</h2><p>T %s</p><section id='discussion'>D %s</section></article>", "Fixed head\nT %s\nD %s"),
    ("<div id='page' class='has-sidebar'><div id='content'>T %s</div><div class='sidebar'>x %s</div></div>", "T %s"),
    ("<article class='post comments-open'>T %s</article><article class='comment post'>x %s</article>", "T %s"),
    ("<main><header><h1>H %s</h1></header><p>T %s</p><div class='comment-list'><div class='comment-body'>x %s</div></div></main>", "H %s\nT %s"),
    ("<article><p>T %s</p><div class='related-posts'><a href=x>x %s</a></div></article>", "T %s"),
    ("<div class='sidebar'><div class='text'>x</div></div><p>y</p><div id='content'>T %s</div>", "T %s"),
    ("<div id='cookie-banner'><div class='content'>x</div></div><div id='content' class='sidebar-right'><h1>H %s</h1>T %s</div>", "H %s\nT %s"),
    ("<div class='has-sidebar'><nav><a href=x>A long list of links</a></nav><a>B</a><main><header><h1><a>H %s</a></h1></header>T</main></div>", "H %s\nT"),
    ("<div class='no-sidebar'><ul><li><a>A long list of links</a></ul><div id='content'>T %s</div></div>", "T %s"),
]


@pytest.mark.parametrize("page, text", KEPT_NAMES)
def test_names_inside_regions_need_evidence(page, text):
    for n in (1, 3, 6):
        names = ["abcdefgh"[i] for i in range(n)]
        assert extracted(*[page.replace("%s", x) for x in names]) == [text.replace("%s", x) for x in names]


def test_names_count_where_texts_repeat():
    page = "<main><div class='topbar'>Our site</div><article><p>T %s</p><div class='social-notice'>Follow us</div></article></main>"
    assert extracted(*[page.replace("%s", x) for x in "abcdef"]) == [f"T {x}" for x in "abcdef"]


@pytest.mark.parametrize("page, text", LAYOUTS)
def test_all_regions_count(page, text):
    for n in (1, 3, 6):
        names = ["abcdefgh"[i] for i in range(n)]
        assert extracted(*[page.replace("%s", x) for x in names]) == [text.replace("%s", x) for x in names]


def test_pages_of_large_hosts_keep_their_regions():
    page = '<html><body class="page %s"><div id="intro">By us</div><div><ul><li><a>x</a></ul></div><div id="content"><p>Text %s</p><p>More %s</p></div></body></html>'
    words = [a + b + "x" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    for n in (1, 3, 60, 160):
        assert extracted(*[page.replace("%s", w) for w in words[:n]]) == [f"Text {w}\nMore {w}" for w in words[:n]]
    slug = '<body><div id="%s"><div>All rights reserved</div><section>Text %s</section></div></body>'
    assert extracted(*[slug.replace("%s", w) for w in words]) == [f"Text {w}" for w in words]
    whole = [html_extraction.expression(parse(slug.replace("%s", w))) for w in words]
    halves = [functools.reduce(html_extraction.aligned, half) for half in (whole[::2], whole[1::2])]
    told = html_extraction.profile(html_extraction.aligned(*halves))
    assert [html_extraction.main_text(slug.replace("%s", w), told) for w in words] == [f"Text {w}" for w in words]


def test_copies_of_a_page_are_no_template():
    page = "<body><p>Views %s</p><div id='content'><h1>Head</h1><p>A short article.</p><section class='social-history'>All of it</section></div></body>"
    copies = [page.replace("%s", x) for x in "abcdefgh"]
    assert extracted(*copies) == ["Head\nA short article.\nAll of it"] * 8
    assert extracted(*copies, *[page.replace("short", x + x) for x in "abcd"])[0] == "Head\nA short article."
    plain = "<body><div><p>Text</p></div><div>Rights</div></body>"
    assert extracted(*[plain] * 6) == ["Text\nRights"] * 6
    others = [plain.replace("Text", x) for x in "abcd"]
    assert extracted(*[plain] * 6, *others) == ["Text"] * 6 + list("abcd")


@pytest.mark.parametrize("depth", [3, 97, 130, 3000])
def test_deep_pages(depth):
    page = "<body><div><article>" + "<div>" * depth + "In %s<nav>x<p>x</p></nav><aside><div>x</div></aside>" + "</div>" * depth
    page += "<p>After %s</p></article></div><p>By us</p></body>"
    assert extracted(*[page.replace("%s", x) for x in "abcde"]) == [f"In {x}\nAfter {x}" for x in "abcde"]
    bare = "<div>" * depth + "<p>Text %s</p><h3>Rights</h3>" + "</div>" * depth
    assert extracted(*[bare.replace("%s", x) for x in "abcde"]) == [f"Text {x}" for x in "abcde"]


@pytest.mark.parametrize("text", ["", "<", "<p", "<!--", "<script>", "</p></p>", "<a <b> c", "&#x110000; &bogus; &am", "<p class='x>y'>t", "<table><li><td>" * 500])
def test_broken_pages(text):
    assert isinstance(extracted(text)[0], str)


def test_extraction_of_odd_rows(spark):
    rows = [(1, None, None), (2, "not an address", ""), (3, "http://h/1", "plain"), (3, "http://h/1", "plain"), (None, "HTTP://u@H:80/2", "<p>a<p>b")]
    table = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], FIELDS).repartition(3)
    got = Counter(tuple(r) for r in html_extraction.extract(table).collect())
    assert got == Counter({(1, None, "", 0): 1, (2, "not an address", "", 0): 1, (3, "http://h/1", "plain", 5): 2, (None, "HTTP://u@H:80/2", "a\nb", 3): 1})
    assert html_extraction.extract(table.limit(0)).count() == 0


def test_extraction_of_the_pages(spark):
    got = {r.page_id: r.text for r in html_extraction.extract(pages(spark)).collect()}
    for r in pages(spark).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def without_names(html):
    """The page with no names to go by."""
    bare = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", bare)


def test_wrappers_find_the_text_without_names(spark):
    """The given pages give the same texts when every class, id and role is gone and articles are divs; without wrappers they do not."""
    by_host = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER.replace('sf0.001', 'sf0.01')}/pages.parquet").collect():
        by_host[re.sub(r"^\w+://|/.*$", "", r.url or "")].append(r.html or "")
    seen = unlike = 0
    for htmls in by_host.values():
        if len(htmls) < 2 * html_extraction.SURE:
            continue
        bare = [without_names(h) for h in htmls]
        texts = extracted(*bare)
        assert texts == extracted(*htmls)
        seen += len(htmls)
        unlike += sum(extracted(b)[0] != t for b, t in zip(bare, texts))
    assert seen and unlike > 0.9 * seen


FRAMED = """<body><main><div class='site-msg'><p>We use cookies on this site.</p></div><div class='crumbs'><a href=/>Home</a> / <a href=/n>News</a>
</div><h1>Head %s</h1><p>Body %s is here.</p><h2>History</h2><p>More %s</p><div class='x-foot'><p>All rights reserved by us.</p></div></main></body>"""


@pytest.mark.parametrize("named", [True, False])
def test_fixed_parts_inside_regions_are_left_out(named):
    page = FRAMED if named else without_names(FRAMED)
    names = ["abcdefghijkl"[i] * 3 for i in range(12)]
    assert extracted(*[page.replace("%s", x) for x in names]) == [f"Head {x}\nBody {x} is here.\nHistory\nMore {x}" for x in names]


def test_texts_of_few_pages_are_no_template():
    """Five of twenty pages begin with the same sentence; it is text."""
    page = "<body><div><p>Advert %s</p></div><div><h1>Head %s</h1><p>{}</p><p>Long text %s</p></div></body>"
    pages = [page.format("The same" if i < 5 else f"Other {i}").replace("%s", str(i) * 9) for i in range(20)]
    assert all(("The same" in t) == (i < 5) for i, t in enumerate(extracted(*pages)))


def test_formulas_and_pages_inside_a_form():
    page = "<body><form id=f><div class='nav menu'>x</div><main><h1>T</h1><p>E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> squared</p></main></form></body>"
    assert extracted(page) == ["T\nE is mc2 squared"]
    assert extracted("<main><p>Text</p><form><p>Subscribe</p><input></form></main>") == ["Text"]


def brute_alignment(a, b):
    """The most labels that two sequences have in common, in order, by trying all choices."""
    best = 0
    for chosen in range(1 << len(a)):
        picked = [x for i, x in enumerate(a) if chosen >> i & 1]
        rest = iter(b)
        if len(picked) > best and all(any(x == y for y in rest) for x in picked):
            best = len(picked)
    return best


def test_alignments_keep_as_much_as_can_be():
    pick = random.Random(3)
    for _ in range(200):
        a, b = ([pick.choice("pqr") for _ in range(pick.randint(0, 7))] for _ in range(2))
        a, b = ([x for x, y in zip(s, [None, *s]) if x != y] for s in (a, b))  # as folded
        parts = [[[x, 0, 0, 1, []] for x in s] for s in (a, b)]
        found = html_extraction.aligned(*parts)
        kept = sum(not p[1] for p in found)
        assert kept <= brute_alignment(a, b) and (kept == brute_alignment(a, b) or any(p[2] for p in found))
        for s in (a, b):  # both fit: leaving out optional parts and repeating others
            pattern = "".join(f"({p[0]}{'+' if p[2] else ''}){'?' if p[1] else ''}" for p in found)
            assert re.fullmatch(pattern, "".join(s))


@pytest.mark.parametrize("piece", ["<div>", "<p>a b c ", "<li><a href=x>y</a>", "<table><tr><td>", "<main><div class=related>a", "x<i>"])
def test_long_broken_pages_take_linear_time(piece):
    times = []
    for n in (5_000, 20_000):
        start = time.perf_counter()
        extracted(piece * n)
        times.append(time.perf_counter() - start)
    assert times[1] < 8 * times[0] + 1
