import html as entities
import random
import re

from pyspark.sql import functions as F

from tidegate.llm import pagetext, queries


def texts(page):
    return pagetext.read(page).article()


def test_what_an_article_leaves_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><form id=aspnet><div class="with-sidebar content"><article class=post>
    <header><h1>Title &amp; more</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Five
    <span class="ad">buy</span> six</p><aside>pull</aside><div class="share-buttons">Share</div><ul><li>a<li>b <i>c</i></ul>
    <script>var x = "</p><p>no";</script><table><tr><td>1<td>2</tr></table><button>Press</button>tail
    <section id="comments"><article class="comment"><p>First!</p></article></section><footer>By me</footer></article></div></form>
    <aside>Side</aside><footer>&copy; 2020</footer><!-- <p>never</p> --></body></html>"""
    assert texts(page) == ["Title & more", "One two three four", "Five six", "a", "b c", "1 2", "tail"]


def test_other_regions():
    assert texts("<main><div class=breadcrumbs>x > y</div><p>text</p></main><div>other</div>") == ["text"]
    assert texts('<div id="entry-content"><p>text</p><p style="display: none">gone</p></div><div>other</div>') == ["text"]
    assert texts('<div class="post"><p>text</p><div class="share">x</div></div><div>other</div>') == ["text"]
    assert texts('<div role="main"><p>text</p></div>') == ["text"] and texts("<div>nothing named</div>") == []
    assert texts("<article>one</article><aside><article>teaser</article></aside><article>two</article>") == ["one", "two"]
    assert texts('<article><p class="ad">x<p>y</article>') == ["y"]


def test_names_of_boilerplate():
    inside = "<article><p>text</p><div class='{}'>other</div></article>"
    for name in ("ad", "box-ads", "adBox_1 advert", "commentlist", "post-comments", "sidebar2", "cookiebar", "topnav", "shareThis share", "related-posts", "newsletterSignup", "NOTICE", "siteFooter"):
        assert texts(inside.format(name)) == ["text"], name
    for name in ("lead", "article-header", "no-sidebar", "has-ads", "shadow", "address", "download", "heading", "navy"):
        assert texts(inside.format(name)) == ["text", "other"], name
    assert texts("<div class='page-header'>Site</div><div class=content>text</div>") == ["text"]


def test_broken_markup():
    assert texts("<article><p>a < b && c &lt;i&gt; &#233;&#x20AC;&unknown; <b>d</article>") == ["a < b && c <i> é€&unknown; d"]
    assert texts("<article>open <p>end") == ["open", "end"] and texts("<article>x<script>never closed <p>y") == ["x"]
    assert texts("<article>x<!-- never closed <p>y") == ["x"] and texts("<article>x<p cla") == ["x"]
    assert texts('<article><a href="x>y</a> z" title=\'q\'>w</a></article>') == ["w"]
    assert texts("<ARTICLE><P>UP</P></ARTICLE>") == ["UP"] and texts("<article></div></p>x</article>y") == ["x"]
    assert texts("<article><!-->x<!--->y</article>") == ["xy"] and pagetext.read("").blocks == []
    deep = "<article>" + "<b><i>" * 50_000 + "x" + "<p>y" * 20_000
    assert len(texts(deep)) == 20_001


def test_hosts():
    assert [pagetext.host(u) for u in ("http://A.b:80/x", "https://u:p@c.d?x", "//e.f#g", "nothing", "", None, "http://[::1]:9/")] == ["a.b", "c.d", "e.f", "", "", "", "[::1]"]


def article_of(page):
    """For the given pages, by their own template."""
    inner = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = [" ".join(entities.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def repeats(pages, window, least):
    """Of each page the blocks that lie whole in repeated runs, by comparing all windows of a host."""
    streams = {}
    for i, (url, page) in enumerate(pages):
        blocks = [["<" + name, *text.split()] for text, _, name in pagetext.read(page or "").outside()]
        streams[i] = pagetext.host(url), blocks
    where = {}
    for i, (host, blocks) in streams.items():
        tokens = [t for b in blocks for t in b]
        for k in range(len(tokens) - window + 1):
            where.setdefault((host, *tokens[k : k + window]), []).append((i, k))
    covered = {i: set() for i in streams}
    for at in where.values():
        if len({i for i, _ in at}) >= least:
            for i, k in at:
                covered[i] |= set(range(k, k + window))
    out = {}
    for i, (_, blocks) in streams.items():
        at, found = 0, []
        for b in blocks:
            found.append(set(range(at, at + len(b))) <= covered[i])
            at += len(b)
        out[i] = found, sum(len(b) - 1 for b, f in zip(blocks, found, strict=True) if f)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op13_main_text"](spark, sf).collect()}
    assert len(got) == len(pages)
    want = repeats([(p.url, p.html) for p in pages], pagetext.WINDOW, pagetext.PAGES)
    for i, p in enumerate(pages):
        r = got[p.page_id]
        assert r.url == p.url and r.text == article_of(p.html) and r.n_chars == len(r.text) and r.n_repeated == want[i][1]
    assert any(r.n_repeated for r in got.values())


def site(rng, n, hosts=("a.example", "b.example")):
    """Pages without any telling markup: the same menu and footer on each page of a host, and sentences of their own."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    menu = {h: " ".join(f"<div><a>{word()} {word()}</a></div>" for _ in range(5)) for h in hosts}
    foot = {h: f"<div>All rights reserved by the people of {h} since {rng.randint(1900, 2000)}</div>" for h in hosts}
    out = []
    for i in range(n):
        h = hosts[0] if rng.random() < 0.7 else hosts[1]
        own = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 4))]
        out.append((i, f"http://{h}/{i}", f"<body>{menu[h]}{''.join(f'<div>{o}</div>' for o in own)}{foot[h]}</body>", "\n\n".join(own)))
    return out


def test_hosts_repeat_what_markup_does_not_name(spark):
    rows = site(random.Random(4), 200)
    rows.append((900, "http://alone.example/", "<div>Menu of one page only</div><div>its text</div>", "Menu of one page only\n\nits text"))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r for r in pagetext.main_text(df).collect()}
    want = repeats([(u, h) for _, u, h, _ in rows], pagetext.WINDOW, pagetext.PAGES)
    for k, (i, _, _, text) in enumerate(rows):
        assert got[i].text == text and got[i].n_repeated == want[k][1]


def test_runs_that_go_on_over_tasks(spark):
    """One host whose pages are nearly alike: each repeated run lies over many tasks, with few pages in some of them."""
    rows = [(i, "http://h/", f"<div>{' '.join(f'w{(k * 7) % 13}' for k in range(40))}</div><div>own {i} text of page {i} here and nothing else {i}</div>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = repeats([(u, h) for _, u, h in rows], 8, 3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r for r in pagetext.main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {i: r.n_repeated for i, r in got.items()} == {i: w for i, (_, w) in want.items()}
    assert all(r.text == f"own {i} text of page {i} here and nothing else {i}" for i, r in got.items())


def test_odd_rows(spark):
    rows = [(1, "http://a/", None, "x"), (2, None, "<article>t</article>", "x"), (2, None, "<article>t</article>", "x"), (None, "http://a/", "", "y"), (3, "http://a/", "just text", None), (4, "http://a/", "<p>" + "wort " * 400_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in pagetext.main_text(df).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "t", 1), (2, "t", 1), (3, "just text", 9), (4, "wort wort", 1_999_999)]
    assert pagetext.main_text(df.where(F.lit(False))).collect() == []
