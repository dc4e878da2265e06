import html
import re
import time

from candlewick.llm import pages, queries

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><h1>Site name</h1><nav><a href="/">Home, sweet home.</a></nav></header>
<div class="cookie-notice"><p>We use cookies, many of them. Agree?</p></div>
<div id="wrap"><div class="post-body"><h2>Head&nbsp;line</h2>
<p>First  paragraph, with <b>bold</b> text &amp; more.<p>Second one; it goes
on, and on.</p><div class="ad"><p>Buy now, please. Great, cheap.</p></div><p>Short.</p></div>
<div class="sidebar"><p>Other text, here. Hello, friend.</p></div></div>
<form><label>Mail, please:</label></form><script>var a = "<p>not text.</p>";</script>
<section id="comments"><p>I liked it, very much. Thank you.</p></section><footer>foot, note.</footer></body></html>"""


def test_content_without_furniture():
    want = "Head line\nFirst paragraph, with bold text & more.\nSecond one; it goes on, and on.\nShort."
    assert pages.main_text(PAGE) == want
    assert pages.main_text(PAGE.replace('<div class="post-body">', "<article>", 1)) == want


def test_paths_of_links_and_thin_paths_are_not_content():
    items = "".join(f"<li><a href='/{i}'>Some linked words, number {i}</a></li>" for i in range(30))
    text = "".join(f"<p>A sentence, with marks; number {i}. It has more, and more.</p>" for i in range(5))
    got = pages.main_text(f"<body><div><ul>{items}</ul></div><div><span>x</span></div><section>{text}</section></body>")
    assert got.count("\n") == 4 and "linked" not in got and "x" not in got.split()
    ratio = pages.path_ratios([("a" * 50 + ".", "body/p", 0.0, False, False), ("b", "body/div", 0.0, False, False), ("cc", "body/ul", 1.0, False, False)])
    assert ratio["body/p"] > ratio["body/div"] > ratio["body/ul"] == 0


STORY = [f"Paragraph {i} of the story, " + "which has many words before a mark is set and then goes on, " * 6 + "to its end." for i in range(5)]
CARDS = [f"Card {i} has some words about another text, which is not long, " + "and not rich in marks " * 3 + "but a few." for i in range(3)]


def cards(attrs="", n=3):
    return "".join(f"<article{attrs}><h3>Other head {i}</h3><p>{CARDS[i]}</p></article>" for i in range(n))


def test_article_elements_do_not_hide_other_content():
    story = "".join(f"<p>{p}</p>" for p in STORY)
    for n in range(4):
        got = pages.main_text(f'<body><div class="story">{story}</div><div class="more">{cards(n=n)}</div></body>').split("\n")
        assert got[:5] == STORY and set(got[5:]) <= {*CARDS, *(f"Other head {i}" for i in range(3))}
    got = pages.main_text(f"<body><article><h1>Head</h1>{story}<ul><li>One</li></ul></article><article><h1>Next</h1>{story}</article></body>")
    assert got.split("\n") == ["Head", *STORY, "One", "Next", *STORY]


def test_names_of_article_elements():
    story = "".join(f"<p>{p}</p>" for p in STORY)
    for attrs in (' class="comment"', ' id="comment-7"', ' class="comment-body even"', ' class="post teaser"', ' style="display: none"'):
        assert pages.main_text(f"<body><main><article>{story}</article>{cards(attrs)}</main></body>").split("\n") == STORY, attrs
    for attrs in (' class="post has-sidebar tag-social"', ' id="post-1"'):
        assert pages.main_text(f'<body><main class="content sidebar-left"><article{attrs}>{story}</article></main></body>').split("\n") == STORY, attrs


def test_short_lines_of_an_article_stay():
    story = "".join(f"<p>{p}</p>" for p in STORY[:2])
    more = [f"Short line {i} of the list" for i in range(6)]
    items = "".join(f"<li>{m}" for m in more)
    menu = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9))
    parts = {f"<ul>{items}</ul>": more, f"<ol>{items}</ol>": more, "<dl><dt>Term<dd>Meaning</dl>": ["Term", "Meaning"],
             "<table><tr><th>Name<th>Count</tr><tr><td>a<td>1</tr></table>": ["Name", "Count", "a", "1"], "<pre>x = 1</pre>": ["x = 1"],
             "<blockquote>Said.</blockquote>": ["Said."], "<div>Line.</div>": ["Line."], "<h3>Part</h3>": ["Part"]}
    end = "<div class='bottom'>All rights are ours</div></body>"
    for part, lines in parts.items():
        want = [*STORY[:2], *lines, STORY[2]]
        for attrs in ("", " class='story'"):
            assert pages.main_text(f"<body><ul>{menu}</ul><div{attrs}>{story}{part}<p>{STORY[2]}</p></div>{end}").split("\n") == want
            assert pages.main_text(f"<div id='page'><div{attrs}><div>{story}</div><div>{part}</div><section><p>{STORY[2]}</p></section></div></div>{end}").split("\n") == want
        assert pages.main_text(f"<body><div><p>{STORY[0]}</p>{part}</div>{end}").split("\n") == [STORY[0], *lines]
        assert pages.main_text(f"<body><div class='entry-content'><div>{story}</div><div>{part}</div></div>{end}").split("\n") == [*STORY[:2], *lines]
        assert pages.main_text(f"<body><div>{STORY[0]}<br>{STORY[1]}{part}</div>{end}").split("\n") == [f"{STORY[0]} {STORY[1]}", *lines]
    assert pages.main_text(f"<body><div>{story}<ul>{menu}</ul></div></body>").split("\n") == STORY[:2]
    assert pages.main_text(f"<body><div class='story'>{story}<h2>Part</h2></div><p>Hello, you.</p><div>{cards()}</div>{end}").split("\n")[:3] == [*STORY[:2], "Part"]


def test_names_that_hold_furniture_words_do_not_hide_the_article():
    story = "".join(f"<p>{p}</p>" for p in STORY)
    foot = "<p>Copyright 2020 ACME.</p>"
    for tag, attrs in (("div", "class='content has-sidebar'"), ("div", "id='post-with-comments'"), ("section", "class='share-price-analysis'"),
                       ("div", "class='job-search-story'"), ("div", "class='legal-news'"), ("form", "action='/x'"), ("div", "class='content sidebar-left'")):
        assert pages.main_text(f"<body><{tag} {attrs}>{story}</{tag}>{foot}</body>").split("\n")[:5] == STORY, attrs
    for attrs in ("class='sidebar-left'", "class='site-footer'", "id='comments'", "class='comment-list'", "class='related-posts'", "class='share-buttons'",
                  "class='comment-body'", "class='main-navigation'", "class='cookie-notice'"):
        beside = f"<div {attrs}><p>{CARDS[0]}</p></div>"
        assert pages.main_text(f"<body><div class='story'>{story}</div>{beside}</body>").split("\n") == STORY, attrs
    form = "<form><label>Your mail, please, and your name, too:</label><p>Sign up.</p></form>"
    assert pages.main_text(f"<body><div>{story}</div>{form}</body>").split("\n") == STORY
    assert pages.main_text(f"<body><form><div>{story}</div><div>Name: <input></div></form></body>").split("\n")[:5] == STORY


def test_an_article_that_is_one_link_stays():
    text = "A long line, which is all a link, of a page; it goes on."
    assert pages.main_text(f"<body><div><p><a href='/x'>{text}</a></p></div></body>") == text
    assert pages.main_text("<body><ul><li><a href='/x'>Home</a></li></ul></body>") == ""


def test_deep_pages_take_linear_time():
    deep = "".join(f"<div>Line {i} of a deep page, with a mark." for i in range(20_000))
    lists = "".join(f"<ul><li>Item {i}, of many." for i in range(20_000))
    ends = "<div>" * 20_000 + "<p>One, two.</p>" + "</section></p></li>" * 20_000
    for page, lines in ((deep, 20_000), (lists, 20_000), (ends, 1)):
        began = time.process_time()
        assert pages.main_text(page).count("\n") == lines - 1
        assert time.process_time() - began < 5


def test_awkward_pages(spark):
    assert [pages.main_text(p) for p in (None, "", "   ", "<p>", "<div><p>a", "</p></div>x <b>y", "&lt;b&gt; &#233;")] == [
        "", "", "", "", "a", "x y", "<b> é"]
    deep = "<div>" * 3000 + "<p>deep, text.</p>"
    assert pages.main_text(deep) == "deep, text."
    rows = spark.createDataFrame([(1, None, "clash"), (1, "<p>a b</p>", None), (None, "<p>a b</p>", "c")], "page_id long, html string, text string")
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in pages.extract(rows).collect()) == [(False, "", 0), (False, "a b", 3), (True, "a b", 3)]
    assert pages.extract(rows.limit(0)).count() == 0


def test_table_equals_its_article_elements(spark, sf):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, sf).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
