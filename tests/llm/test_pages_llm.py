"""Operators on pages and vectors: edge cases, and results against plain brute force."""

from __future__ import annotations

import html
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from edge_cases import stored

from rollbook.llm import crosspolytope, dom, linkgraph, revisits, wrapper
from rollbook.llm.oracle import ORACLE

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
<header>Site &amp; name</header><nav><ul><li><a href="/a">A{n}</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies {n}</div><div class="promo-box"><p>Buy {n}</div>
<div class="x"><p>Welcome, dear reader</p>
<article><header><h1>Head&eacute; {n}</h1></header><p>One   <b>bold</b>
text {n}<br>more<p>Two &lt;tags&gt; {n}</p>{more}<form>Mail <input></form></article></div>
<aside>Side {n}</aside><section id="comments"><p>Nice {n}!</p></section><footer>End {n}</footer></body>"""


def article(n: int, paragraphs: int) -> str:
    more = "".join(f"<p>Part {k} of {n}</p>" for k in range(paragraphs))
    return ARTICLE.replace("{n}", str(n)).replace("{more}", more)


def wanted(n: int, paragraphs: int, welcome: bool) -> str:
    lines = ["Welcome, dear reader"] * welcome
    lines += [f"Headé {n}", f"One bold text {n} more", f"Two <tags> {n}"]
    return "\n".join(lines + [f"Part {k} of {n}" for k in range(paragraphs)])


PAGE = "page_id BIGINT, url STRING, html STRING, tree STRING, host INT, blocks STRING"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(n, f"https://many.org/{n}", article(n, n % 4)) for n in range(20)]
    rows += [(100, "http://few.org", article(100, 1)), (101, "http://few.org", article(101, 0))]
    rows += [
        (200, None, None),
        (201, "", ""),
        (202, "x", "<p>open <div>in &#233; div"),
        (203, "http://a/", "just text & more <"),
        (204, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (205, "http://long/", "<article>" + "<p>same</p>" * 3000 + "</article>"),
        (None, "http://a/", "<!-- <p>no</p> --><p>yes</p><style>p{}</style>"),
        (206, "http://a/", "<script>never closed"),
        (207, "http://twice/", "<p>twice</p>"),
        (207, "http://twice/", "<p>twice</p>"),
    ]
    frame = spark.createDataFrame([(*r, "t", 1, None) for r in rows], PAGE)
    return stored(spark, frame, tmp_path_factory.mktemp("pages") / "pages")


def test_wrappers_take_the_template_away(pages):
    got = [(r.page_id, r.text, r.n_chars) for r in wrapper.extract(pages, stored=True).collect()]
    assert len(got) == 32 and all(n == len(t) for _, t, n in got)
    text = dict((i, t) for i, t, _ in got)
    for n in range(20):  # the welcome is on every page of the host
        assert text[n] == wanted(n, n % 4, welcome=False)
    assert text[100] == wanted(100, 1, welcome=True)  # two pages tell nothing
    assert text[200] == text[201] == text[206] == ""
    assert text[202] == "open\nin é div" and text[203] == "just text & more <"
    assert text[204] == "deep" and text[205] == "\n".join(["same"] * 3000)
    assert text[None] == "yes"
    assert [t for i, t, _ in got if i == 207] == ["twice", "twice"]


def test_copies_of_a_page_are_no_template(spark):
    same = "<div><p>One article</p><p>of two blocks</p></div>"
    rows = [(n, "http://rows.org/a", same) for n in range(12)]
    rows += [(n, f"http://ids.org/a?session={n}", same) for n in range(20, 32)] + [(40, None, same)] * 9
    # ten distinct pages and many copies of one: a line on all is template, the copied one is not
    shown = "<div><p>Top of all</p><p>Text {}</p></div>"
    rows += [(n, f"http://mixed.org/{n}", shown.format(min(n, 109))) for n in range(100, 250)]
    frame = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = [(r.page_id, r.text) for r in wrapper.extract(frame).collect()]
    assert len(got) == len(rows)
    for n, text in got:
        assert text == ("One article\nof two blocks" if n < 100 else f"Text {min(n, 109)}")


def test_an_optional_block_does_not_hide_the_template(spark):
    page = (
        "<body>{}<div><a href=a>Home</a><b><a href=b>News</a></b></div><div><i>Notice to all</i></div>"
        "<section><h1>Title {}</h1><p>Dear reader</p>{}</section><div><u>All rights kept</u></div></body>"
    )
    rows = []
    for n in range(20):
        parts = "".join(f"<p>Part {k} of {n}</p>" for k in range(1 + n % 3))
        rows.append((n, f"http://some.org/{n}", page.format("<em>Banner</em>" * (n == 7), n, parts)))
    frame = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.text for r in wrapper.extract(frame).collect()}
    for n in range(20):  # the first paragraph is one of a list
        lines = ["Banner"] * (n == 7) + [f"Title {n}", "Dear reader"]
        assert got[n] == "\n".join(lines + [f"Part {k} of {n}" for k in range(1 + n % 3)])


def kept(source):
    page = dom.parse(source)
    return [t for t, n in zip(page.texts, page.block_nodes, strict=True) if not page.chrome[n]]


@pytest.mark.parametrize(
    "source",
    [
        '<div class="layout no-sidebar"><article><p>Text of it</article></div>',
        '<article class="post has-comments"><p>Text of it</article>',
        '<main id="search-algorithms"><p>Text of it</main>',
        '<article class="post-share-price"><p>Text of it</article>',
        '<form id="aspnet"><nav>Menu</nav><main><p>Text of it</main></form>',
        '<div class="sidebar"><article><p>Text of it</article></div><div class="footer">End</div>',
        '<div class="popup"><p>Text of it</div>',
        '<div><p>Text of it</div><aside><article><p>Next</article></aside>',
        '<article><p>Text of it</article><div id="comments"><article class="comment-body"><p>A very long comment of a reader</article></div>',
        '<article><p>Text of <a class="advert" href="/">Buy</a>it</article>',
        '<article><p><b class="comment">No <b>never</b> ever</b>Text of it</article>',
        '<article><p><span class="ad">No <span>never</span> ever</span>Text of it</article>',
        '<article><p class="site-footer">End</p><span class="ad">Open <p>Buy</p></article><p>Text of it',
    ],
)
def test_labels_are_no_judges_of_the_article(source):
    assert kept(f"<html><body>{source}</body></html>") == ["Text of it"]


def test_very_long_lists_of_children_in_bounded_memory():
    draw = random.Random(3)
    tags = ["p", "div", "ul", "dl"]

    def page():
        own = [draw.choice(tags) for _ in range(20_000)]
        return [0] + [1] * len(own), ["page", *own]

    matcher = dom.Matcher()
    one, other = matcher.tree(*page()), matcher.tree(*page())
    tracemalloc.start()
    pairs = matcher.align(one, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(pairs) > 10_000
    assert all(one.tags[a] == other.tags[b] for a, b in pairs)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")
    assert wrapper.extract(none).count() == 0
    assert linkgraph.verdicts(none).count() == 0
    assert revisits.resolve(revisits.captures_of(none)).count() == 0


def test_articles_of_the_driver_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extract(pages, stored=True).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(line for line in lines if line)


def test_matching_is_the_largest():
    """Against the plain recursion over all pairs of children."""
    draw = random.Random(4)

    def grown(depth: int, out: list, level: int = 1) -> list:
        out.append((level, draw.choice("abc") if level > 1 else "r"))
        if level < depth:
            for _ in range(draw.randint(0, 4)):
                grown(depth, out, level + 1)
        return out

    def plain(one, a, other, b) -> int:
        if one.tags[a] != other.tags[b]:
            return 0
        x, y = one.children[a], other.children[b]
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                best[i + 1, j + 1] = max(
                    best[i, j + 1], best[i + 1, j], best[i, j] + plain(one, c, other, d)
                )
        return 1 + best[-1, -1]

    for _ in range(200):
        matcher = dom.Matcher()
        one, other = (
            matcher.tree([d for d, _ in t], [g for _, g in t]) for t in (grown(4, []), grown(4, []))
        )
        pairs = matcher.align(one, other)
        assert len(pairs) == plain(one, 0, other, 0)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


# ---------------------------------------------------------------- url filters


def test_urls_and_rules(spark):
    urls = {
        "https://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "//x.net/es/1": ("", "", None, "allow"),
        "http://É.com/a://b": ("É.com", "/a://b", "com/", "allow"),
        None: ("", "", None, "allow"),
    }
    frame = spark.createDataFrame(
        [(n, u, None, 1) for n, u in enumerate(urls)], "page_id INT, url STRING, html STRING, rule INT"
    )
    got = {r.page_id: tuple(r)[1:] for r in linkgraph.verdicts(frame).collect()}
    # the only pages of x.net are blocked, and so would be its others
    assert [got[n] for n in range(len(urls))] == list(urls.values())


def test_distrust_runs_against_links_and_trust_along_them(spark):
    def link(*hosts):
        return "".join(f"<p><A class=x HREF='//{h}/p'>l</A>" for h in hosts)

    rows = [
        (1, "http://bad.net/es/", link("bad.net")),
        (2, "http://near.org/", link("bad.net", "bad.net")),
        (3, "http://far.org/", '<a href="https://near.org/x">'),
        (4, "http://good.com/", link("both.org", "fine.org")),
        (5, "http://both.org/", link("bad.net", *["fine.org"] * 30)),
        (6, "http://fine.org/", None),
    ]
    frame = spark.createDataFrame(rows, "page_id INT, url STRING, html STRING")
    got = {r.page_id: r.verdict for r in linkgraph.verdicts(frame).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_ranks_by_power_iteration(spark):
    draw = random.Random(2)
    edges = {(draw.randrange(9), draw.randrange(9)): float(draw.randint(1, 5)) for _ in range(30)}
    frame = spark.createDataFrame(
        [(0, f"h{a}", f"h{b}", n) for (a, b), n in edges.items() if a != b and a != 5],
        "walk INT, source STRING, target STRING, links DOUBLE",
    )
    seeds = spark.createDataFrame([(0, "h1", 1.0), (0, "h2", 3.0)], "walk INT, host STRING, seed DOUBLE")
    got = {r.host: r["rank"] for r in linkgraph.ranks(frame, seeds).collect()}
    m = np.zeros((9, 9))
    for (a, b), n in edges.items():
        if a != b and a != 5:
            m[b, a] = n
    start = np.zeros(9)
    start[1], start[2] = 0.25, 0.75
    for a in range(9):  # without links out the walk goes back to the seeds
        m[:, a] = m[:, a] / m[:, a].sum() if m[:, a].any() else start
    now = start
    for _ in range(300):
        now = 0.15 * start + 0.85 * m @ now
    for n in range(9):
        assert got.get(f"h{n}", 0) == pytest.approx(now[n], abs=3e-9)


def same_by_sql(frame):
    """Verdicts of pages by Spark and by the SQL twin."""
    pages = frame.toPandas()  # noqa: F841
    base = duckdb.connect()
    base.register("pages", pages)
    want = {r[0]: r[-1] for r in base.execute(ORACLE["op7_link_graph"]).fetchall()}
    got = {r.page_id: r.verdict for r in linkgraph.verdicts(frame).collect()}
    assert got == want
    return got


def test_distrust_has_no_longest_way(spark):
    rows = [(0, "http://h0.net/es/", None)]
    rows += [(n, f"http://h{n}.org/", f'<a href="http://h{n - 1}.{"net" if n == 1 else "org"}/x">') for n in range(1, 31)]
    rows += [(31, "http://other.org/", '<a href="http://h31.org/">')]
    got = same_by_sql(spark.createDataFrame(rows, "page_id INT, url STRING, html STRING"))
    assert [got[n] for n in range(32)] == ["block"] * 31 + ["allow"]


def test_a_graph_of_ten_thousand_hosts(spark):
    draw = random.Random(8)
    ends = ["com", "org", "org", "org", "de", "de", "net"]
    names = [f"h{n}.{draw.choice(ends)}" for n in range(10_000)]
    rows = []
    for n, name in enumerate(names):
        # early hosts are linked to most; a hub has links to a tenth of all
        links = [names[int(len(names) * draw.random() ** 3)] for _ in range(draw.randrange(6) if n else 1000)]
        html = "".join(f'<a href="//{to}/">' for to in links)
        rows.append((n, f"http://{name}/{draw.choice(['es', 'fr', 'de'])}/", html, 7))
    frame = spark.createDataFrame(rows, "page_id INT, url STRING, html STRING, rank INT")
    got = same_by_sql(frame.drop("rank"))
    assert got == {r.page_id: r.verdict for r in linkgraph.verdicts(frame).collect()}
    assert 0 < sum(v == "block" for v in got.values()) < len(got)


# ---------------------------------------------------------------- revisits


def test_revisits_take_the_latest_earlier_response(spark):
    day = revisits.STRETCH
    url, same = "http://www.X.org:80/a/?b=2&a=1&utm_source=q#f", "https://x.org/a?a=1&b=2"
    rows = [
        # id, url, at, status, etag, modified, body, headers
        (1, url, 10, 200, '"e"', "m", "old", {"etag": '"e"', "date": "1", "content-length": "3"}),
        (2, same, 20, 200, '"f"', "m", "new", {"etag": '"f"', "date": "2"}),
        (3, same, 20, 200, '"f"', "m", "tie", None),
        (4, same, 15, 304, 'W/"e"', None, None, {"date": "9", "content-length": "0", "server": "s"}),
        (5, url, 20, 304, None, None, None, None),
        (6, url, 9 * day, 304, None, "m", None, {"expires": "never"}),
        (7, url, 9 * day, 304, '"other"', "m", None, None),
        (8, url, 9, 304, None, None, None, None),
        (9, None, 50, 304, None, None, None, None),
        (10, same, None, 304, None, None, None, None),
        (11, "http://y.org/", 5, 304, None, None, None, None),
        (12, same, 30, 404, None, None, "no", None),
        (13, "http://z.org", 1, 200, None, None, None, None),
        (14, "http://z.org/", 1, 304, None, None, None, None),
    ]
    kind = (
        "capture_id INT, url STRING, at BIGINT, status INT, etag STRING, modified STRING,"
        " body STRING, headers MAP<STRING, STRING>, full INT, stretch STRING, fresh INT"
    )
    frame = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], kind)
    got = {r.capture_id: r for r in revisits.resolve(frame).collect()}
    assert {i: (r.response_id, r.status, r.body) for i, r in got.items()} == {
        4: (1, "resolved", "old"),
        5: (3, "resolved", "tie"),
        6: (3, "resolved", "tie"),
        7: (3, "mismatch", None),
        8: (None, "no_response", None),
        9: (None, "no_response", None),
        10: (None, "no_response", None),
        11: (None, "no_response", None),
        14: (13, "resolved", None),
    }
    assert got[4].headers == {"etag": '"e"', "date": "9", "content-length": "3"}
    assert got[6].headers == {"expires": "never"}


def test_repeated_and_missing_capture_ids(spark):
    kind = (
        "capture_id INT, url STRING, at BIGINT, status INT, etag STRING, modified STRING,"
        " body STRING, headers MAP<STRING, STRING>"
    )
    x, y = "http://x.org/", "http://y.org/"
    rows = [(2, x, 10, 200, None, None, "a", None)] * 3 + [(3, x, 20, 304, None, None, None, None)] * 3
    rows += [
        (None, y, 1, 200, None, None, "b", None),
        (None, y, 2, 304, None, None, None, None),
        (3, None, 2, 304, None, None, None, None),
        (2, y, 9, 200, None, None, "c", None),
        (3, y, 9, 304, None, None, None, None),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r.capture_id), str(r.url_key), r.response_id or 0, r.status, r.body) for r in got) == [
        ("3", "None", 0, "no_response", None),
        *[("3", "x.org", 2, "resolved", "a")] * 3,
        ("3", "y.org", 2, "resolved", "c"),
        ("None", "y.org", 0, "resolved", "b"),
    ]
    # a page that stands three times has a revisit each
    page = [(4, x, "<p>a</p>")] * 3
    frame = spark.createDataFrame(page, "page_id BIGINT, url STRING, html STRING")
    assert revisits.resolve(revisits.captures_of(frame), placed=True).count() == 3


def test_malformed_urls_share_no_key(spark):
    urls = {
        " http://a.com/x": "a.com/x",
        "\thttp://b.org/\ny ": "b.org/y",
        "1x://c.net/z": None,
        "://d.net/z": None,
        "d.net/?u=http://e.com/": None,
        "http:///x": None,
        "http://:80/x": None,
        "http://www.f.com:80/": "f.com",
        "https://f.com:80/": "f.com:80",
        "HTTPS://F.com:443?b&a#c?d": "f.com?a&b",
        "": None,
        None: None,
    }
    rows = []
    for n, url in enumerate(urls):
        rows += [(2 * n, url, 1, 200, None, None, f"body {n}", None, 0)]
        rows += [(2 * n + 1, url, 2, 304, None, None, None, None, 0)]
    kind = (
        "capture_id INT, url STRING, at BIGINT, status INT, etag STRING, modified STRING,"
        " body STRING, headers MAP<STRING, STRING>, seconds INT"
    )
    got = {r.capture_id: r for r in revisits.resolve(spark.createDataFrame(rows, kind)).collect()}
    for n, key in enumerate(urls.values()):
        r = got[2 * n + 1]
        assert (r.url_key, r.body) == (key, None if key is None else f"body {n}")


def test_a_hot_url_within_a_day(spark):
    draw = random.Random(4)
    rows = []
    for n in range(3000):
        full = draw.random() < 0.3
        at = draw.randrange(400) * 500
        rows.append((n, "http://hot.org/", at, 200 if full else 304, None, None, f"b{n}", None))
    kind = (
        "capture_id INT, url STRING, at BIGINT, status INT, etag STRING, modified STRING,"
        " body STRING, headers MAP<STRING, STRING>"
    )
    got = {r.capture_id: r.response_id for r in revisits.resolve(spark.createDataFrame(rows, kind)).collect()}
    full = [(r[2], r[0]) for r in rows if r[3] == 200]
    want = {r[0]: max((f for f in full if f[0] <= r[2]), default=(0, None))[1] for r in rows if r[3] == 304}
    assert got == want


# ---------------------------------------------------------------- neighbours


def brute_nearest(rows, every, nearest):
    found = {}
    for q, v in rows:
        if q % every:
            continue
        scored = [
            (-float((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum())), i) for i, w in rows if i != q
        ]
        found[q] = [i for _, i in sorted(scored)[:nearest]]
    return found


def test_recall_against_brute_force(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 64))
    data = centres[draw.integers(0, 40, 6000)] * 0.5 + draw.normal(size=(6000, 64))
    rows = [(n, v.astype(np.float32).astype(float)) for n, v in enumerate(data)]
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in rows], "vec_id INT, embedding ARRAY<FLOAT>")
    got = crosspolytope.search(frame).collect()
    want = brute_nearest(rows, 50, 5)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert len(got) == 5 * len(want) and hits >= 0.9 * len(got)


def test_the_driver_vectors_are_found_exactly(spark):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in frame.collect()]
    got = {}
    for r in sorted(crosspolytope.search(frame).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_nearest(rows, 50, 5)  # so few that all buckets are looked into


def test_rows_of_one_vec_id_do_not_push_others_out(spark):
    draw = np.random.default_rng(3)
    near = np.eye(8)[0] + 0.01 * draw.normal(size=(10, 8))
    others = np.eye(8)[0] + 0.1 * draw.normal(size=(12, 8))
    rows = [(0, np.eye(8)[0])] + [(1, v) for v in near] + [(n + 2, v) for n, v in enumerate(others)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id INT, embedding ARRAY<DOUBLE>")
    got = sorted(crosspolytope.search(frame).collect(), key=lambda r: r["rank"])
    want = list(dict.fromkeys(brute_nearest(rows, 50, len(rows))[0]))[:5]
    assert want[0] == 1 and [r.vec_id for r in got] == want


def test_vector_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (0, one), (1, [2.0, 4.0, 6.0]), (2, one), (3, one), (3, one), (4, None), (5, [0.0] * 3),
        (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]),
        (9, []), (None, one), (50, [1.0, 2.0]), (100, [1.0]), (150, one), (10, [-1.0, -2.0, -3.0]),
    ]
    frame = spark.createDataFrame(
        [(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, bucket INT"
    )
    got = crosspolytope.search(frame).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by[0]) == {1, 2, 3, 10, 150} and by[0][-1] == 10
    assert set(by) == {0, 150} and len(by[150]) == 5
    assert crosspolytope.search(frame.limit(0)).count() == 0


def test_what_is_compared_grows_slower_than_the_index():
    """Production settings at three sizes: recall of 0.9, and ever smaller shares compared."""
    draw = np.random.default_rng(4)
    shares = []
    for known in (2_000, 8_000, 32_000):
        vectors = draw.normal(size=(known, 64))
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        axes = crosspolytope.parts(known, 64)
        filed = crosspolytope.buckets(vectors, axes, crosspolytope.TABLES, 1)[:, :, 0]
        found = met = 0
        for query in range(0, known, known // 40):
            asked = vectors[query : query + 1]
            looked = crosspolytope.buckets(
                asked, axes, crosspolytope.TABLES, crosspolytope.probes_for(axes, known)
            )[0]
            seen = np.zeros(known, dtype=bool)
            for table, joint in enumerate(looked):
                seen |= np.isin(filed[:, table], joint)
            near = unit @ unit[query]
            near[query] = -2
            found += seen[np.argsort(-near)[:5]].sum()
            met += seen.sum()
        asks = len(range(0, known, known // 40))
        assert found >= 0.9 * 5 * asks
        shares.append(met / asks / known)
    assert shares[1] < 0.75 * shares[0] and shares[2] < 0.75 * shares[1]


def test_probes_are_the_nearest_joint_buckets():
    vectors = np.random.default_rng(5).normal(size=(20, 12))
    axes = (32, 32, 4)
    for row, tables in zip(vectors, crosspolytope.buckets(vectors, axes, 2, 60)):
        unit = crosspolytope.scaled(row[None])
        unit /= np.linalg.norm(unit)
        for table, joint in enumerate(tables):
            one, two, three = (crosspolytope._signed(unit, table, p, c)[0] for p, c in enumerate(axes))
            total = (one[:, None, None] + two[None, :, None] + three[None, None, :]).ravel()
            assert np.allclose(np.sort(total[joint]), np.sort(total)[-60:])


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324, 1.7e308])
def test_doubles_of_any_size(spark, size):
    draw = np.random.default_rng(6)
    rows = [(i, [float(v) for v in draw.uniform(0.5, 1, 8) * size * draw.choice((-1, 1), 8)]) for i in range(30)]
    if size < 1e-300:
        rows = [(i, [float(v) for v in draw.integers(1, 9, 8) * size]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = crosspolytope.search(frame, every=30).collect()
    exact = {i: [np.ldexp(x, -int(np.frexp(np.abs(v).max())[1])) for x in v] for i, v in rows}
    scores = sorted(
        ((float(np.dot(exact[0], v) / np.linalg.norm(exact[0]) / np.linalg.norm(v)), -i) for i, v in exact.items() if i),
        reverse=True,
    )
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [-i for _, i in scores[:5]]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == pytest.approx([s for s, _ in scores[:5]])


def test_a_cell_of_copies_is_dealt_into_blocks(spark, monkeypatch):
    """Most rows share a bucket: they are compared block by block, and none is lost."""
    monkeypatch.setattr(crosspolytope, "BLOCK_ROWS", 40)
    monkeypatch.setattr(crosspolytope, "BLOCK_QUERIES", 5)
    draw = np.random.default_rng(7)
    near = draw.normal(size=16)
    rows = [(i, [float(v) for v in near + draw.normal(size=16) * 1e-3]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {}
    for r in crosspolytope.search(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for query, ranked in got.items():
        scores = unit @ unit[query]
        scores[query] = -2
        assert set(ranked.values()) == set(np.argsort(-scores)[:5])
    assert sorted(got) == list(range(0, 600, 50))
