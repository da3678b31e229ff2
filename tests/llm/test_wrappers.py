import random

import pytest

from spectrel.llm import queries_wrappers, wrappers
from tests.llm.fixtures import prose

SCHEMA = "page_id long, url string, html string, host string, pages int, wrapper string, part string, text string"


def blocks(r, layout):
    """Markup of an article's blocks, and their texts."""
    out, texts = [], []

    def add(markup, *found):
        out.append(markup)
        texts.extend(found)

    title = prose(r.random(), 5, 400)
    add(f"<h1>{title} &amp; more</h1>", f"{title} & more")
    for _ in range(r.randint(2, 9)):
        t = [prose(r.random(), r.randint(8, 40), 400) for _ in range(3)]
        kind = r.choice("ppppulqth")
        if kind == "p":
            add(f"<p>{t[0]}\n\t <b>{t[1]}</b><br>{t[2]}&nbsp;&lt;x&gt;", f"{t[0]} {t[1]} {t[2]} <x>")
        elif kind == "u":
            add(f"<ul><li>{t[0]}<li>{t[1]} <a href=x>link</a></ul>", t[0], f"{t[1]} link")
        elif kind == "l":
            add(f"<h2>{t[0]}</h2><p>{t[1]}</p>", t[0], t[1])
        elif kind == "q":
            add(f"<blockquote>{t[0]}<p>{t[1]}</blockquote>", t[0], t[1])
        elif kind == "t":
            add(f"<table><tr><td>{t[0]}<td>{t[1]}</table>", t[0], t[1])
        else:
            add(f"<div>{t[0]}<script>var a = '<p>no</p>';</script></div><!-- <p>no</p> -->", t[0])
    if layout == "article" and r.random() < 0.5:
        k = r.randint(0, len(out))
        out.insert(k if k else 1, f'<div class="ad-slot"><p>{prose(r.random(), 9)}</p></div><aside>{prose(r.random(), 9)}</aside>')
    return "".join(out), texts


MENU = "<ul>" + "".join(f"<li><a href=/{x}>{x} page</a>" for x in ("home", "news", "sport", "about")) + "</ul>"


def page(r, layout):
    body, texts = blocks(r, layout)
    noise = [prose(r.random(), r.randint(5, 25), 300) for _ in range(4)]
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{noise[0]}</title><style>p{{}}</style></head>"
    comments = "".join(f"<p>{prose(r.random(), 12, 300)}</p>" for _ in range(r.randint(0, 5)))
    if layout == "article":
        return f'{head}<body><header><h2>{noise[1]}</h2><nav>{MENU}</nav></header><div class="cookieNotice"><p>{noise[2]}</p></div><article class="post">{body}<section id="comments">{comments}</section></article><form><p>{noise[3]}</p><input></form><footer><p>{noise[0]}</p></footer>', texts
    if layout == "main":
        return f'{head}<body><div class="site-header">{MENU}</div><main><header>{body}</header></main><div class="sidebar"><p>{noise[1]}</p></div><div role="contentinfo">{noise[3]}</div></body></html>', texts
    if layout == "div":
        return f'{head}<body><div id="top">{MENU}</div><div id="wrap"><div id="content">{body}</div><div class="sidebar"><p>{noise[1]}</p></div><div class="comment-list">{comments}</div></div><div class="footer">{noise[2]}</div>', texts
    return f"{head}<body><div>{MENU}</div><div><div>{body}</div><div>Subscribe to our letter now, it is free.</div></div><div>Made by us, all rights are ours.</div>", texts


LAYOUTS = ["article", "main", "div", "plain"]


def site(seed, layout, n):
    r = random.Random(seed)
    return [page(r, layout) for _ in range(n)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, layout):
    pages = site(1, layout, 60)
    frame = spark.createDataFrame([(i, f"http://H{layout}.org/{i}?x", p, "x", 1, "x", "x", "x") for i, (p, _) in enumerate(pages)], SCHEMA).repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()}
    assert got == {i: "\n\n".join(t) for i, (_, t) in enumerate(pages)}


def test_one_page_of_a_host():
    for layout in LAYOUTS[:3]:
        for p, texts in site(2, layout, 20):
            tree = wrappers.parsed(p)
            assert wrappers.texts_of(tree, wrappers.decided(wrappers.learn(tree), 1)) == texts


def test_shared_text_goes_but_copies_stay():
    def both(bodies):
        trees = [wrappers.parsed(f"<article><h1>Same</h1>{b}<div>Read us every day.</div></article>") for b in bodies]
        known = wrappers.learn(trees[0])
        for t in trees[1:]:
            known = wrappers.align(known, wrappers.learn(t))
        return [wrappers.texts_of(t, wrappers.decided(known, len(trees))) for t in trees]

    assert both([f"<p>{i} one<p>two" for i in range(9)]) == [["Same", f"{i} one", "two"] for i in range(9)]
    assert both(["<p>one"] * 9) == [["Same", "one", "Read us every day."]] * 9
    assert both([f"<p>{i}" for i in range(3)])[2] == ["Same", "2", "Read us every day."]


def test_union_free_expressions():
    def shape(items):
        return " ".join((("(" + shape(x[3]) + ")" if x[0][0] in "(*" else x[0] + ("=" if x[0] == "#" and x[3][0] is not None else "") + (f"<{shape(x[3])}>" if x[0] != "#" and x[3] else "")) + "+" * x[2] + "?" * x[1]) for x in items)

    def of(*pages):
        out = wrappers.learn(wrappers.parsed(pages[0]))
        for p in pages[1:]:
            out = wrappers.align(out, wrappers.learn(wrappers.parsed(p)))
        return shape(out)

    assert of("<div>a</div>", "<div>a</div>") == "div<#=>"
    assert of("<div>a</div>", "<div>b</div>") == "div<#>"
    assert of("<p>a<p>b<p>c") == "p<#>+"
    assert of("<h1>a</h1><p>b", "<h1>a</h1><table></table><p>b") == "h1<#=> table? p<#=>"
    assert of("<h2>a</h2><p>b<h2>c</h2><p>d<p>e", "<h2>a</h2><p>b") == "(h2<#> p<#>+)+"
    assert of("<h2>a</h2><p>b", "<h2>a</h2><p>b<h2>c</h2><p>d") == "(h2<#> p<#>)+"


def test_wide_and_deep_pages_stay_bounded():
    r = random.Random(3)
    tags = ["p", "ul", "pre", "h3", "table", "section"]
    pages, texts = [], []
    for _ in range(6):
        t = [prose(r.random(), 3) for _ in range(300)]
        pages.append("<article>" + "".join(f"<{(g := r.choice(tags))}>{x}</{g}>" for x in t) + "</article>")
        texts.append(t)
    known = wrappers.learn(wrappers.parsed(pages[0]))
    for p in pages[1:]:
        known = wrappers.align(known, wrappers.learn(wrappers.parsed(p)))
    assert len(str(known)) < 5000
    assert [wrappers.texts_of(wrappers.parsed(p), wrappers.decided(known, 6)) for p in pages] == texts
    deep = wrappers.parsed("<div>" * 5000 + "x" + "</div>" * 5000 + "<div>y</div>")
    assert wrappers.texts_of(deep, wrappers.decided(wrappers.learn(deep), 1)) == ["x", "y"]
    assert wrappers.parsed('<a "' * 20_000 + "<p>z").children


ODD = [
    (None, ""), ("", ""), ("  \n", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b &lt;i&gt; &amp;lt; &#233;&#x1F600;", "a\n\nb <i> &lt; é😀"), ("<article>a<nav>b</nav>c</article>", "a\n\nc"),
    ("<article>x < y & z &am &amp</article>", "x < y & z &am &"), ("<article><p>open <b>tags <i>everywhere<p>here", "open tags everywhere\n\nhere"), ("<script>if (a < b) {}", ""), ("<!-- open", ""),
    ("<article><style>p</style><form><p>f</p></form><button>no</button><p hidden>h</p><span class=ad>ad</span>t<wbr>u</article>", "tu"),
]


def test_odd_pages_and_query_columns(spark, tmp_path):
    rows = [(i, f"http://odd{i}.example/", h, "x", 1, "x", "x", "x") for i, (h, _) in enumerate(ODD)]
    rows += [(50, None, "<article>q</article>", *rows[0][3:]), (50, None, "<article>q</article>", *rows[0][3:]), (None, "no scheme", "<article>r</article>", *rows[0][3:])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries_wrappers.op12_html_extraction(spark, str(tmp_path)).collect()), key=repr)
    want = [(i, f"http://odd{i}.example/", t, len(t)) for i, (_, t) in enumerate(ODD)] + [(50, None, "q", 1)] * 2 + [(None, "no scheme", "r", 1)]
    assert got == sorted(want, key=repr)


def test_shuffled_join_rounds_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    pages = [(f"http://h{k % 3}.org/", *p) for k, p in enumerate(site(4, "main", 40))]
    frame = spark.createDataFrame([(i, u, p, "x", 1, "x", "x", "x") for i, (u, p, _) in enumerate(pages)], SCHEMA).repartition(9)
    known = wrappers.fit(frame)
    assert sorted((r["host"], r["pages"]) for r in known.collect()) == [("h0.org", 14), ("h1.org", 13), ("h2.org", 13)]
    assert {r["page_id"]: r["text"] for r in wrappers.extract(frame, known).collect()} == {i: "\n\n".join(t) for i, (*_, t) in enumerate(pages)}
    assert wrappers.extract(frame.limit(0)).count() == 0
