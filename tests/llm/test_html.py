import html as entities
import random
import re

import numpy as np
import pytest

from assayframe.llm import html as H

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sources(spark):
    return [r.html for r in spark.read.parquet(f"{D}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(sources):
    return H.train(sources[:120])


def article(source):
    """The article element by pattern: holds for the tables' own layout only."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:h1|p|article)\b[^>]*>", body)
    return " ".join(t for p in parts if (t := " ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split())))


def test_own_layout(sources, model):
    got = H.extract(sources, model)
    assert sum(g == article(s) for g, s in zip(got, sources)) >= 0.99 * len(sources)


def overlap(got, want):
    from collections import Counter
    a, b = Counter(got.split()), Counter(want.split())
    n = sum((a & b).values())
    return 2 * n / max(1, sum(a.values()) + sum(b.values()))


def test_drawn_layouts_of_other_pages(sources, model):
    rng, scores = random.Random(99), []
    stock = [w for s in sources[120:160] for t in H.Page(s).text for w in t.split()]
    for s in sources[120:200]:
        pieces = [" ".join(t.split()) for t in H.Page(s).text if len(t) > 60][:8]
        if pieces:
            page, label = H.labelled(H.layout(pieces, stock, rng))
            x, parent, depth, _ = H.features([page])
            kept = H.decide(1 / (1 + np.exp(-model.margin(x))), parent, depth, np.array(page.follows))
            scores.append(overlap(H.join_blocks(page, kept), H.join_blocks(page, label & np.array([n == H.TEXT for n in page.names]))))
    assert np.mean(scores) > 0.95, np.mean(scores)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div>
<header class="site-header"><a href="/">Site name</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav></header>
<div class="layout"><aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story of today</a></li><li><a href="/y">Another old story</a></li></ul></aside>
<div class="post-content"><h1>A &amp; B</h1><p>The first paragraph of the story has <b>bold</b> text,
and more than one line, so it is rather long and tells a lot.</p><div class="ad">Buy now, cheap things for sale!</div>
<p>The second paragraph goes on with the story, as paragraphs do, and ends it after some more words.</p></div></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I did not like this story at all, it was far too long for me.</p></div></section>
<form action="/s"><label>Search</label><input name="q"></form>
<footer><p>&copy; 2020 Site name. All rights reserved.</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_unseen_page(model):
    got = H.extract([PAGE], model)[0]
    want = ("A & B The first paragraph of the story has bold text, and more than one line, so it is rather long and tells a lot. "
            "The second paragraph goes on with the story, as paragraphs do, and ends it after some more words.")
    assert got == want


def test_decision_is_consistent():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 11))
        parent = np.array([0] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, dtype=int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        p = rng.uniform(0.02, 0.98, n)
        follows = (rng.random(n) < 0.3) & (depth > 0)
        kept = H.decide(p, parent, depth, follows)
        best = -np.inf
        for bits in range(2**n):  # all choices that keep nothing below a dropped node
            k = np.array([bits >> i & 1 for i in range(n)], dtype=bool)
            if all((not k[i] or k[parent[i]]) and (not follows[i] or k[i] == k[parent[i]]) for i in range(1, n)):
                best = max(best, np.where(k, np.log(p), np.log(1 - p)).sum())
        assert all((not kept[i] or kept[parent[i]]) and (not follows[i] or kept[i] == kept[parent[i]]) for i in range(1, n))
        assert np.isclose(np.where(kept, np.log(p), np.log(1 - p)).sum(), best)


@pytest.mark.parametrize("source", [None, "", " ", "<", "<p", "<!--", "<script>x", "</p></p>", "<a><b></a></b>", "&amp", "<p>" * 3000, "<div>" * 2000 + "x", "text only", "<table><td>x<td>y<tr><td>z"])
def test_odd_markup(model, source):
    assert isinstance(H.extract([source], model)[0], str)


def test_query_and_odd_rows(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (None, "u", PAGE), (1, "u", PAGE), (4, "u", "<article><p>" + "very long text, " * 50_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_pages(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and [r.n_chars for r in got if r.page_id == 4] == [50_000 * 16 - 1]
    assert H.extract_pages(df.limit(0), H.fit(df.limit(0))).collect() == []


def test_formulas_are_text(sources, model):
    source = next(s for s in sources[120:] if re.search(r"<article>.*?<p>[^<]{80,}</p>", s, re.S))
    start = source.index("<p>", source.index("<article>")) + 3
    formula = "<math display='inline'><semantics><mrow><mi>zeta</mi><mo>=</mo><msup><mi>rho</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>hiddenform</annotation></semantics></math>"
    got = H.extract([source[:start] + f"before {formula} after " + source[start:]], model)[0]
    assert "before zeta=rho2 after " in got and "hiddenform" not in got

P = "The first paragraph tells how the river rose in spring, and how the old bridge was lost within an hour."
Q = "A second one adds that the town built a new bridge of stone, which took the builders eleven years."
R = "In the end, the council named it after the miller, who had warned them all for a decade."
PAGES = {
    "br inside a paragraph": (f"<article><h1>Bridge</h1><p>{P}<br>Second line<br/>Third line</p><p>{Q}</p></article>", f"Bridge {P} Second line Third line {Q}"),
    "br without blanks": (f"<article><p>one<br>two</p><p>{P}</p><p>{Q}</p></article>", f"one two {P} {Q}"),
    "blank between inline elements": (f"<article><p>See <b>one</b> <i>two</i> here. {P}</p><p><em>alpha</em>\n<strong>beta</strong> {Q}</p></article>", f"See one two here. {P} alpha beta {Q}"),
    "no blank between inline elements": (f"<article><p>un<b>believ</b>able <i>H</i><sub>2</sub>O. {P}</p><p>{Q}</p></article>", f"unbelievable H2O. {P} {Q}"),
    "links in the text": (f"<article><h2>Bridge</h2><p><a href='/a'>first link</a> <a href='/b'>second link</a> text. {P}</p><p>{Q} <a href='/c'>third link</a></p></article>", f"Bridge first link second link text. {P} {Q} third link"),
    "bare body": (f"<html><body><h1>Bridge</h1><p>{P}</p><p>{Q}</p></body></html>", f"Bridge {P} {Q}"),
    "six long paragraphs in body": ("<body>" + "".join(f"<p>{t}</p>" for t in (P, Q, R) * 2) + "</body>", " ".join((P, Q, R) * 2)),
    "plain div": (f"<body><div><h1>Bridge</h1><p>{P}</p><p>{Q}</p></div></body>", f"Bridge {P} {Q}"),
    "layout table": ("<body><table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a><br><a href='/c'>Contact</a></td><td>" + "".join(f"<p>{t}</p>" for t in (P, Q, R, P, Q, R, P, Q)) + "</td></tr></table></body>", " ".join((P, Q, R, P, Q, R, P, Q))),
    "definition list": (f"<main><h1>Bridge words</h1><dl><dt>Pier</dt><dd>{P}</dd><dt>Arch</dt><dd>{Q}</dd></dl></main>", f"Bridge words Pier {P} Arch {Q}"),
    "list in an article": (f"<article><h1>Bridge</h1><p>{P}</p><ul><li>stone from the quarry</li><li>wood from the upper valley</li></ul><p>{Q}</p></article>", f"Bridge {P} stone from the quarry wood from the upper valley {Q}"),
    "menu and footer around a bare body": (f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><h1>Bridge</h1><p>{P}</p><p>{Q}</p><p>{R}</p><footer><p>&copy; 2020 The Site. All rights reserved.</p></footer></body>", f"Bridge {P} {Q} {R}"),
    "advert between paragraphs": (f"<article><h1>Bridge</h1><p>{P}</p><div class='ad'>Buy cheap boats now!</div><p>{Q}</p></article>", f"Bridge {P} {Q}"),
    "comments below": (f"<article><h1>Bridge</h1><p>{P}</p><p>{Q}</p></article><section id='comments'><h2>Comments</h2><div class='comment'><p>I never liked that bridge, it is far too narrow for a cart.</p></div></section>", f"Bridge {P} {Q}"),
    "sidebar beside": (f"<div class='row'><div class='post-body'><h1>Bridge</h1><p>{P}</p><p>{Q}</p></div><aside class='sidebar'><h3>Popular</h3><ul><li><a href='/x'>Ten fine fords</a></li><li><a href='/y'>Floods of the year</a></li></ul></aside></div>", f"Bridge {P} {Q}"),
    "cookie notice": (f"<body><div class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>OK</button></div><article><h1>Bridge</h1><p>{P}</p><p>{Q}</p></article></body>", f"Bridge {P} {Q}"),
    "script within a word": (f"<article><p>wo<script>var x = '</p>';</script>rd. {P}</p><p>{Q}</p></article>", f"word. {P} {Q}"),
    "quotes and tables in an article": (f"<article><h1>Bridge</h1><p>{P}</p><blockquote><p>{R}</p></blockquote><table><tr><th>Year</th><th>Length</th></tr><tr><td>1820</td><td>90 feet</td></tr></table><p>{Q}</p></article>", f"Bridge {P} {R} Year Length 1820 90 feet {Q}"),
    "character references": (f"<article><h1>Caf&eacute; &amp; bridge</h1><p>{P} 3 &lt; 4&nbsp;&#33;</p><p>{Q}</p></article>", f"Café & bridge {P} 3 < 4 ! {Q}"),
    "unclosed paragraphs": (f"<body><div class=content><h1>Bridge</h1><p>{P}<p>{Q}<p>{R}</div>", f"Bridge {P} {Q} {R}"),
    "text beside blocks": (f"<article><h1>Bridge</h1>{P} <b>Mind</b> <i>that</i>.<p>{Q}</p>{R}</article>", f"Bridge {P} Mind that. {Q} {R}"),
    "search form above": (f"<body><form action='/s'><label>Search the site</label><input name=q><button>Go</button></form><main><h1>Bridge</h1><p>{P}</p><p>{Q}</p></main></body>", f"Bridge {P} {Q}"),
    "nested divs without names": (f"<body><div><div><div><h1>Bridge</h1><div><p>{P}</p><p>{Q}</p></div></div></div></div></body>", f"Bridge {P} {Q}"),
    "one short paragraph": ("<body><p>Only one short line.</p></body>", "Only one short line."),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(model, name):
    source, want = PAGES[name]
    assert H.extract([source], model)[0] == want
