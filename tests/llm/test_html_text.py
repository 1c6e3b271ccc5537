"""Main text of pages made of known texts, and of pages of the smallest table."""

import html
import random
import re

from gaugewatch.llm import html_text

SMALL = "/root/testdata/sf0.001/pages.parquet"


def test_tags_and_noise():
    page = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
    <body><header><h2>Site</h2></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
    <article class="post ad-free"><header><h1>A &amp; B</h1></header><p>One   two
    <b>three<i> four</i></b>&nbsp;five<p>Six<br>seven<div class="advert big">Buy</div><aside>More</aside>
    <form><input value=x>Search</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section id="comments"><p>First!</p></section>&#233;&lt;p&gt;</article>
    <div id="sidebar">S</div><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page, None) == "A & B\nOne two three four five\nSix\nseven\na\nb\nc\nd\né<p>"


def test_nothing_to_extract():
    for page in ("", "   ", "<p", "<html><body><nav>x</nav></body></html>", "<script>x", "<!-- x"):
        assert html_text.main_text(page, None) == ""


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(SMALL)
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want) and got[row.page_id].url == row.url


def test_template_of_hosts_without_article(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(8))
    rows, want = [], {}
    for i in range(30):
        texts = [prose() for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in texts)
        rows.append((i, f"http://a.example/{i}", f"<html><body><div class='top'>The Daily Sheet</div><div>{body}</div><div>All the news</div></body></html>", "x", 1))
        want[i] = "\n".join(texts)
    alone = "<html><body><div>Hello</div><p>World</p></body></html>"
    rows += [(100, "http://b.example/", alone, "x", 1), (101, "http://c.example/", alone, "x", 1)]
    rows += [(102 + i, f"https://user@D.example:80/{i}", "<html><body><article><p>copy</p></article></body></html>", "x", 1) for i in range(5)]
    rows += [(200, None, alone, "x", 1), (201, "http://a.example/x", None, "x", 1), (202, "", "", "x", 1), (None, "http://b.example/2", alone, "x", 1)]
    want |= {100: "Hello\nWorld", 101: "Hello\nWorld", 200: "Hello\nWorld", 201: "", 202: "", None: "Hello\nWorld"} | {102 + i: "copy" for i in range(5)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template int").repartition(4)
    got = html_text.main_texts(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    names = {r.host for r in html_text.templates(pages).collect()}
    assert "a.example" in names and "b.example" not in names


def test_empty_table(spark):
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_decides_pages_with_article(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        a, b, c = prose(6), prose(20), prose(20)
        rows.append((i, f"http://teaser.example/{i}", f"<body><article><p>{a}</p></article><div><p>{b}</p><p>{c}</p></div></body>"))
        want[i] = f"{a}\n{b}\n{c}"
        rows.append((100 + i, f"http://main.example/{i}", f"<body><main><p>Read it every day</p><p>{b}</p><div>Printed on paper</div></main></body>"))
        want[100 + i] = b
        # Copies of one article under other titles: the text is not a template's.
        rows.append((200 + i, f"http://copy.example/{i}", f"<head><title>{i}</title></head><body><article><p>one text</p><p>another of the same</p></article></body>"))
        want[200 + i] = "one text\nanother of the same"
    rows += [(300, "http://alone.example/", "<body><article><p>teaser</p></article><div><p>the body of the text</p></div></body>")]
    want[300] = "teaser\nthe body of the text"
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_names_and_comments_drop_nothing_else():
    body = "<article><div class='entry-header'><h1>Title</h1></div><div class='header'>By us</div><p class='share-price'>Text</p></article>"
    want = "Title\nBy us\nText"
    for name in ("content has-sidebar", "no-sidebar", "page-with-header", "widget", "main banner"):
        assert html_text.main_text(f"<div class='{name}' id='{name.split()[0]}'>{body}<div class='comments'><article>Me too</article></div></div>", None) == want
        assert html_text.main_text(f"<div class='{name}'><p>Long text of a page</p></div><div class='ad-slot'>Buy</div>", None) == "Long text of a page"
    for name in ("ad", "site-footer", "ad-slot big", "cookie-notice", "menu-1"):
        assert html_text.main_text(f"{body}<div class='{name}'>x</div><p>.</p><div id='{name.split()[0]}'>y</div>", None) == want
    assert html_text.main_text(f"{body}<div id='sidebar'><article>Teaser</article></div><div class='comments'>{'long ' * 99}</div>", None) == want
    for head in ("<script>var s = '<!-- ';</script>", "<style><!-- p{}</style>", "<title>a <!-- b</title>", "<form><textarea><!-- </textarea></form>"):
        assert html_text.main_text(f"{head}{body}", None) == want
        assert html_text.main_text(f"{body}{head}<p>.</p><!-- <p>gone</p>", None) in (want, want + "\n.")
    assert html_text.main_text("<p>a < b & c<p>d <!-- x --> e &am", None) == "a < b & c\nd e &am"


def host_pages(count):
    """Articles with an own text, a line that all share, and a heading that 13 of 20 have."""
    rows = []
    for i in range(count):
        heading = "<h2>Summary</h2>" if i % 20 < 13 else ""
        html = (
            f"<html><body><div class='top'><p>Daily paper</p></div><article><h1>Title {i}</h1>{heading}"
            f"<p>Body of story {i} with some words.</p><p>Share this story</p></article><div class='end'><p>All of it</p></div></body></html>"
        )
        rows.append((i, f"https://paper.example/{i}", html))
    return rows


def test_frequent_headings_are_slots_unless_their_vector_is_the_articles(spark):
    rows = host_pages(20)
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        heading = ["Summary"] if i < 13 else []
        assert got[i].split("\n") == [f"Title {i}", *heading, f"Body of story {i} with some words."]


def test_template_follows_from_vectors(spark, monkeypatch):
    pages = spark.createDataFrame(host_pages(20), "page_id long, url string, html string")
    (row,) = html_text.templates(pages).collect()
    held = {name: html_text.token_hash(f"/html/body/{name}") in row.template for name in (
        "div.top/p>Daily paper", "div.end/p>All of it", "article/p>Share this story", "article/h2>Summary",
    )}
    assert held == {
        "div.top/p>Daily paper": True, "div.end/p>All of it": True, "article/p>Share this story": True, "article/h2>Summary": False,
    }


def test_classes_are_kept_or_dropped_whole():
    # (token, holder, text of an article): 1 holds 2; 4 is held by 9, which no class has, so 3 goes with it.
    assert html_text.nested_classes([[(1, 0, False), (2, 1, False)], [(3, 1, False), (4, 9, False)]]) == {0, 1, 2}
    # A text of an article must have the article in its class; with one class for all, everything would be kept.
    article, text, often = (5, 0, False), (6, 5, True), (7, 5, True)
    assert html_text.nested_classes([[article, text], [often]]) == {0, 5, 6}
    assert html_text.nested_classes([[article, text, often]]) == {0, 5, 6, 7}
    # Nested in any order.
    assert html_text.nested_classes([[(3, 2, False)], [(2, 1, False)], [(1, 0, False)]]) == {0, 1, 2, 3}
