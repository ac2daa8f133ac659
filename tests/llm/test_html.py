import random

from conftest_llm import sentence
from fieldaudit.llm import html_text as h

ROWS = [(h.with_run(x), y) for x, y in h.LABELLED]
TREE = h.grow(ROWS)


def test_tree_fits_its_table():
    assert all(h.classify(TREE, x) == y for x, y in ROWS)


def test_article_is_kept_and_furniture_dropped():
    rng = random.Random(1)
    p = [sentence(rng, n) for n in (40, 3, 120, 1, 25)]
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body>
    <header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li><li><a href=/b>News</a></li></ul></nav></header><div class="cookie-notice">{sentence(rng, 30)}</div>
    <div class=ad>{sentence(rng, 12)}</div><main><article><h1>A &amp; B</h1><p>{p[0]}<p>{p[1]}<br>{p[2]}</p><form>Name <input> <label>{sentence(rng, 9)}</label></form>
    <p><b>{p[3]}<p>{p[4]}</b> caf&eacute;&nbsp;&#33;</p><aside>{sentence(rng, 50)}</aside></article>
    <section id="comments"><h3>Comments</h3><p>{sentence(rng, 60)}</p></section></main><div class="sidebar">{sentence(rng, 40)}</div>
    <footer>&copy; x {sentence(rng, 20)}</footer></body></html>"""
    assert h.main_text(page, TREE) == "\n".join(["A & B", p[0], f"{p[1]} {p[2]}", p[3], f"{p[4]} café !"])


def test_page_without_article_element():
    rng = random.Random(2)
    p = [sentence(rng, 60) for _ in range(3)]
    page = f"<body><div><a>Home</a></div><div><a>News</a></div>{''.join(f'<div><p>{x}</p></div>' for x in p)}<div>all rights reserved</div></body>"
    assert h.main_text(page, TREE) == "\n".join(p)


def test_odd_markup():
    for page, want in (("", ""), (None, ""), ("<", ""), ("<p", ""), ("<!-- x", ""), ("<article>a < b &lt; c</article>", "a < b < c"),
                       ("<article><p title='a > b'>x y</p></article>", "x y"), ("</div></article><article><p>in</p></div></p>still</article>", "in\nstill"),
                       ("<article><script>x", ""), ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"), ("<article>&amp;lt;</article>", "&lt;"),
                       ("<article><p>a\n\t b</p></article>", "a b")):
        assert h.main_text(page, TREE) == want, page
    assert h.main_text("<article>" + "<p>w</p>" * 20_000, TREE).count("\n") == 19_999
    assert h.main_text("<article><p " + "\"" * 30_001, TREE) == ""


def test_frame(spark):
    rows = [(1, "u", "<article><p>one</p></article>", "x"), (2, None, None, None), (2, "u", "", "x"), (None, "u", "<nav>a</nav>", "x")]
    df = h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r["row"]["page_id"] or 0, r["text"]) for r in df.collect()) == [(0, ""), (1, "one"), (2, ""), (2, "")]
    assert h.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_given_pages(spark, tiny):
    """The article of every given page, cut out by its tags."""
    import html
    import re

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    for r in h.extracted(pages).collect():
        body = re.search("<article>(.*?)</article>", r["row"]["html"], re.S).group(1)
        parts = (html.unescape(re.sub("</?b>|<br>", " ", x)).split() for x in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(" ".join(x) for x in parts if x)


def test_attribute_values_of_any_length():
    long = "{'a': 1 > 0, class='ad'}" * 1_000
    page = f"""<article><p>one</p><div class=x data-props="{long}"><p>two</p><div>three</div></div><p>four</p></article>
    <nav data-items='{long.replace("'", "")}'><div>menu</div></nav><p>after</p>"""
    assert len(long) > 20_000
    assert h.main_text(page, TREE) == "one\ntwo\nthree\nfour"
    assert [b.text for b in h.blocks(page) if b.furniture] == ["menu"]


def test_unclosed_values_take_linear_time():
    for page in ("<article>" + "<p a='><p' " * 40_000 + "b=\"", "<article>" + "<p a=\">\" " * 40_000, "<article>" + "<p a=" * 40_000 + "\"x>y"):
        h.main_text(page, TREE)
    assert h.main_text("<article><p title=\"x>y</p><p>z</p></article>", TREE) == "y\nz"


def test_wrappers_with_names_of_furniture():
    rng = random.Random(4)
    p = [sentence(rng, n) for n in (60, 35, 80)]
    text = "".join(f"<p>{x}</p>" for x in p)
    for wrapper in ("<div class='content has-sidebar'>", "<div class=elementor-widget-container>", "<section id='related'>", "<div class='legal'><div class='side'>"):
        end = "</div></div>" if "legal" in wrapper else "</section>" if "section" in wrapper else "</div>"
        page = f"<body><div><a href=/>Home</a></div>{wrapper}{text}<div class=comments><p>{sentence(rng, 40)}</p></div>{end}<div class=sidebar>{sentence(rng, 30)}</div></body>"
        assert h.main_text(page, TREE) == "\n".join(p), wrapper
    page = f"<div class='sidebar-left'><p>{sentence(rng, 90)}</p><article>{text}<div class=share>{sentence(rng, 25)}</div></article></div>"
    assert all(x in h.main_text(page, TREE) for x in p) and h.main_text(page, TREE).count("\n") <= 3
    assert h.main_text(f"<div hidden><article>{text}</article></div>", TREE) == ""


def test_short_blocks_and_headings_without_article_element():
    rng = random.Random(5)
    long = [sentence(rng, 70) for _ in range(3)]
    for n in range(1, 11):
        short, head = sentence(rng, n), sentence(rng, n)
        page = f"<div><a href=/>Home</a></div><h2>{head}</h2><p>{long[0]}</p><p>{short}</p><p>{long[1]}</p><h2>{head}</h2><p>{long[2]}</p>"
        want = [head, long[0], short, long[1], head, long[2]]
        assert h.main_text(page, TREE) == "\n".join(want), n
        assert h.main_text(f"<div><a href=/>Home</a></div><div>{short}</div><div><a href=/>News</a></div>", TREE) == "", n


def test_only_links_with_a_target_count():
    rng = random.Random(6)
    p = [sentence(rng, 50) for _ in range(2)]
    assert h.main_text(f"<p><a name=top>{p[0]}</p><p>{p[1]}</p>", TREE) == "\n".join(p)
    assert [b.link_words for b in h.blocks(f"<p><a href=x>one two<p>{p[0]}")] == [2, 0]


def test_pages_of_short_paragraphs():
    """Without an article element, paragraphs of 3 to 15 words come back whole when there are enough of them."""
    rng = random.Random(7)
    for n in range(3, 16):
        for many in (6, 14, 40):
            if n * many < 45:
                continue
            for menu in ("", "<ul><li><a href=/>Home</a></li><li><a href=/n>News today</a></li></ul>"):
                p = [sentence(rng, n) for _ in range(many)]
                for head in ("", "<h1>Short news</h1>"):
                    page = f"<body>{menu}{head}{''.join(f'<p>{x}</p>' for x in p)}</body>"
                    assert h.main_text(page, TREE) == "\n".join(["Short news"] * bool(head) + p), (n, many, menu, head)


def test_formulas_and_fallback_text_stay():
    assert h.main_text("<article><p>where <math><mi>x</mi></math> is one</p><object data=a.pdf>see the <b>paper</b></object> <canvas>a bar chart</canvas></article>", TREE) \
        == "where x is one\nsee the paper a bar chart"
    assert h.main_text("<article><p>a <svg><title>icon</title><text>b</text></svg> c</p></article>", TREE) == "a b c"


def test_stray_and_unclosed_tags_take_linear_time():
    import time

    cases = ["<article>" + "<div>" * 50_000 + "x" + "</span>" * 50_000, "<span><article>" + "<div>" * 50_000 + "</span>" * 50_000 + "x",
             "<article>x" + "<option>" * 100_000, "<article>x" + "<select></select " * 50_000, "<article>x" + "</p>" * 100_000, "<article>x" + "<i></b>" * 50_000]
    for page in cases:
        start = time.process_time()
        assert h.main_text(page, TREE).startswith("x"), page[:40]
        assert time.process_time() - start < 2.5, page[:40]
