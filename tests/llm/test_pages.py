"""Extraction from pages of several templates, labelled by hand, and the cut's own part in it."""

import random
import time

from logweave.llm import html_extract as H

LONG = "The river rises in the hills above the town, and for most of the year it is low enough to be crossed on foot. "
MORE = "When the snow melts, however, the water reaches the lower streets, and people move what they can to the upper floors. "

#: (name, page, its content blocks in order)
TEMPLATES = [
    (
        "no telling names",
        f"""<html><head><title>x</title></head><body><div><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>
<div><div><h1>The river</h1><p>{LONG}</p><p>{MORE}{LONG}</p><div>A short line.</div><p>{MORE}</p></div></div>
<div><p>Get our stories by mail, every morning at six, free of charge.</p><input name=mail><button>Join</button></div>
<div><a href=/a>About us</a> <a href=/b>Contact</a> <a href=/c>Terms</a></div></div></body></html>""",
        ["The river", LONG, MORE + LONG, "A short line.", MORE],
    ),
    (
        "inline spans and hyphened names",
        f"""<body><nav><a href=x>One</a></nav><article><h2 class="post-title">Science</h2><p><span class="popular">Popular</span> science {LONG}</p>
<p class="related-work">Related work {MORE}</p><div class="social-security">Social security {LONG}</div><p>See <a class="ad" href=q>the report</a> of {MORE}</p></article>
<div class="share-buttons"><a href=f>Share</a> <a href=g>Send</a></div></body>""",
        ["Science", "Popular science " + LONG, "Related work " + MORE, "Social security " + LONG, "See the report of " + MORE],
    ),
    (
        "nested comments",
        f"""<main><h1>A walk</h1><p>{LONG}</p><p>{MORE}</p></main><section id="comments"><h3>2 comments</h3><ol>
<li><div><b>Ann</b><p>I walked there last year, and it was lovely, thank you for this.</p><ol><li><p>So did I, and I would go again at any time of the year.</p></li></ol></div></li></ol></section>""",
        ["A walk", LONG, MORE],
    ),
    (
        "tables and lists",
        f"""<div id=menu><ul><li><a href=1>Start</a><li><a href=2>Maps</a></ul></div><div class=content><h1>Levels</h1><p>{LONG}</p>
<table><tr><th>Year<th>Level<tr><td>2001<td>3.2 m<tr><td>2002<td>2.9 m</table><ul><li>{MORE}<li>Dry summers lower it.</ul></div><div class="sidebar-right"><p>{LONG}</p></div>""",
        ["Levels", LONG, "Year", "Level", "2001", "3.2 m", "2002", "2.9 m", MORE, "Dry summers lower it."],
    ),
    (
        "a misleading name around the article",
        f"""<body><div class="related"><h1>Floods</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG}{MORE}</p></div><div class="related"><a href=1>Other floods</a><a href=2>More floods</a></div><div class="copyright"><p>&copy; 2024</p></div></body>""",
        ["Floods", LONG, MORE, LONG + MORE],
    ),
    (
        "notices, adverts, hidden parts and forms",
        f"""<body class="has-sidebar"><div id="cookie-banner"><p>We use cookies on this site to make it better for all who read it.</p></div><header><p>The Daily River, since 1901.</p></header>
<div role=main><p>{LONG}</p><div class="ad-slot-1"><p>Buy boots now, and walk through every flood with dry feet.</p></div><p>{MORE}</p><p style="display: none">Hidden text that no reader ever sees on the page.</p>
<script>document.write("<p>no</p>")</script><form action=/s><p>Search the whole archive of our paper.</p><input></form></div><footer><p>{LONG}</p></footer></body>""",
        [LONG, MORE],
    ),
    ("unclosed tags", f"<article><h1>Tags<p>{LONG}<p>One <b>bold line.<p>{MORE}<ul><li>a first item.<li>a second item.</article><aside>{LONG}", ["Tags", LONG, "One bold line.", MORE, "a first item.", "a second item."]),
]


def one_space(x):
    return " ".join(x.split())


def test_templates():
    hit = found = wanted = 0
    for name, page, want in TEMPLATES:
        want, got = [one_space(x) for x in want], H.main_text(page).split("\n")
        same = [x for x in got if x in want]
        hit, found, wanted = hit + len(same), found + len(got), wanted + len(want)
        assert same == [x for x in want if x in got], name  # in page order
    precision, recall = hit / found, hit / wanted
    assert 2 * precision * recall / (precision + recall) >= 0.95


def test_the_cut_decides():
    """Some blocks end on the other side than their own costs, and than those with their mark's, would have them."""
    own = marked = 0
    for _, text, _ in TEMPLATES:
        page = H.Page(text)
        content, boiler, edges = H.graph(page)
        side = H.minimum_cut(content, boiler, edges)
        for i, b in enumerate(page.blocks):
            own += side[i] != (content[i] > boiler[i])
            mark = page.marks[b.frame.mark][0] if b.frame.mark >= 0 else 0.0
            pull = H.SCALE * H.HELD * ((mark > 0) - (mark < 0))
            marked += side[i] != (content[i] - boiler[i] + pull > 0)
    assert own >= 5 and marked >= 2


def test_linear_time():
    makes = [
        lambda n: "<a " * n + '"', lambda n: "<div>word " * n, lambda n: "<i>" * n + "</b>" * n, lambda n: "<p>one two three." * n, lambda n: "<script " * n, lambda n: "<!-- " * n,
        lambda n: '<div class="popular"><p>text of words here.' * n, lambda n: "<p a='" * n, lambda n: "<td>" * n + "</table>" * n, lambda n: "<" * n, lambda n: "<textarea>" * n,
    ]
    for make in makes:
        started = time.process_time()
        H.main_text(make(20_000))
        assert time.process_time() - started < 6


def test_any_markup_is_taken():
    rng = random.Random(12)
    parts = ["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "<li>", "<table>", "<tr>", "<td>", "text of it. ", "&amp;", "&nbsp;", "<", ">", '"', "'", "<!--", "-->", "<br>", "<script>", "</script>", "<a href=x>", "</a>", "<article>", "</article>", "</", "<!x", "<input>", "\n"]
    for _ in range(3000):
        text = H.main_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
        assert text == "\n".join(one_space(x) for x in text.split("\n"))


def test_odd_tables(spark):
    page = "<article><p>" + LONG + "</p></article>"
    pages = spark.createDataFrame([(1, page, "a"), (1, page, "b"), (None, None, "c"), (2, "", "d")], "page_id long, html string, text string")
    got = H.extract(pages)
    assert got.columns == ["page_id", "html", "text", "_text"]
    assert sorted((r["text"], r["_text"]) for r in got.collect()) == [("a", LONG.strip()), ("b", LONG.strip()), ("c", ""), ("d", "")]
    assert H.extract(pages.limit(0)).count() == 0
    long = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert H.main_text(long).count("\n") == 4999
