import random
import re
from html import unescape

import numpy as np

from pointlens.llm.html import extract, extract_text, runs_of
from pointlens.llm.queries import op9_html_text


def test_query_keeps_exactly_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op9_html_text(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h\d)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_without_an_article_element():
    body = "<p>The first paragraph has some length, as text has.</p><div class='ad-box'>Buy now, buy all of it, really!</div><p>The second one &mdash; &#233;&amp;c. &nbsp; too.</p><ul><li>item one</li><li>item</li></ul>"
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div id="main-menu"><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></div>
      <div class="content"><h2>Title</h2>{body}</div><form><p>Your mail</p><input></form><div class="cookieNotice"><p>We use cookies, all kinds of cookies.</p></div>
      <section id="comments"><p>Nice text, says a reader at some length here.</p></section><footer>(c)</footer><script>var a = "<p>no</p>";</script></body></html>"""
    text = "Title\n\nThe first paragraph has some length, as text has.\n\nThe second one — é&c. too.\n\nitem one\n\nitem"
    assert extract_text(page) == text
    assert extract_text(page.replace("</footer>", "").replace("</body></html>", "")) == text


def test_adverts_and_headers_inside_an_article():
    page = "<main><article><header><h1>Head line</h1></header><p>one</p><aside>side</aside><p>two<br>three</p><div role='complementary'>x</div><table><tr><td>a</td><td>b</td></tr></table><div hidden>h</div></article><div class='related'>more</div></main>"
    assert extract_text(page) == "Head line\n\none\n\ntwo three\n\na\n\nb"
    assert extract_text("<article><p>a < b and <b>bold</b>text &lt;i&gt;</p><!-- <p>no</p> --></article>") == "a < b and boldtext <i>"


def test_headlines_in_named_headers():
    page = "<div class='site-header'>Site name</div><div class='entry'><div class='entry-header'><h1>Head</h1></div><p>Text of some length follows here.</p></div><ol class='commentlist'><li>I agree with all of it, and more.</li></ol>"
    assert extract_text(page) == "Head\n\nText of some length follows here."


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>x</p>"), (3, "u", "plain"), (4, "u", "<p>" + "y " * 200000), (5, "u", "<nav><a>only menu</a></nav>"), (6, "u", "<<>><p <p a='>b</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): r.text for r in extract(pages).collect()}
    assert found[1, None] == found[2, "u"] == found[5, "u"] == "" and found[None, "u"] == "x" and found[3, "u"] == "plain" and found[4, "u"] == ("y " * 200000).strip()
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).collect() == []


LONG = "This is a paragraph of running text that is long enough to be told from a label or a caption, one should think."


def test_wrappers_are_no_surroundings():
    for name in ("content has-sidebar", "layout with-sidebar", "page no-footer", "commentary", "commentator-text"):
        assert extract_text(f"<div class='{name}'><p>{LONG}</p><p>The end.</p></div>") == f"{LONG}\n\nThe end."
    assert extract_text(f"<form action='/'><p>{LONG}</p><p>{LONG}</p><input></form>") == f"{LONG}\n\n{LONG}"
    assert extract_text(f"<div class='widget'><h1>Head</h1><p>{LONG}</p></div><div class='widget'><p>{LONG}</p></div>") == f"Head\n\n{LONG}"
    assert extract_text(f"<div class='sidebar-page'><article><p>{LONG}</p></article></div>") == LONG
    assert extract_text(f"<div id='comments'><article><p>{LONG}</p></article></div><article><p>Text.</p></article>") == "Text."


def test_attribute_values_are_not_names():
    assert extract_text(f"<p title='the hidden truth'>{LONG}</p><p data-x=hidden>b</p><p hidden>c</p><p hidden='hidden'>d</p>") == f"{LONG}\n\nb"


def test_articles_side_by_side_and_teasers():
    assert extract_text(f"<article><p>{LONG}</p></article><article><p>Second.</p></article>") == f"{LONG}\n\nSecond."
    body = "\n\n".join([LONG] * 4)
    page = "<article><a href='/x'>Read this, too, it is about something else</a></article><div>" + f"<p>{LONG}</p>" * 4 + "</div>"
    assert extract_text(page) == body


def test_unclosed_choice_list():
    assert extract_text(f"<select><option>one<option>two<p>{LONG}</p>") == LONG
    assert extract_text(f"<div><select><option>one</div><p>{LONG}</p>") == LONG


def test_link_paragraphs_and_link_lists():
    link = "<p><a href='/a'>A paragraph that is one link and nothing else</a></p>"
    menu = "".join(f"<li><a href='/{i}'>Entry number {i}</a></li>" for i in range(5))
    assert extract_text(f"<p>{LONG}</p>{link}<p>{LONG}</p>").count("one link") == 1
    assert extract_text(f"<p>{LONG}</p>{link}").endswith("nothing else")
    assert extract_text(f"<p>{LONG}</p><ul>{menu}</ul>") == LONG
    for page in (f"<article><p>{LONG}</p><ul>{menu}</ul></article>", f"<article><p>{LONG}</p><ul>{menu}</ul><p>x</p></article>"):
        assert extract_text(page).count("Entry") == 5  # an article is kept whole
        assert LONG in extract_text(page)


def test_the_window_decides():
    two = "".join(f"<li><a href='/{i}'>Entry number {i}</a></li>" for i in range(2))
    page = f"<div><p>{LONG}</p><ul>{two}</ul><p>The end.</p></div>"
    assert "Entry number 1" in extract_text(page) and "Entry number 1" not in extract_text(page, window=1)
    assert "Entry number 1" not in extract_text(page, window=2) and extract_text(page).endswith("The end.")
    small = f"<div>Label</div><div><a>x</a></div><div><a>x</a></div><div><a>x</a></div><p>{LONG}</p>"
    assert extract_text(small) == LONG and extract_text(small, surge=1) == f"Label\n\n{LONG}" and extract_text(small, window=50).startswith("Label")


def test_closing_section_behind_an_advert():
    page = f"<div><p>{LONG * 50}</p><div class='ad'>Buy this.</div><p>{LONG}</p><aside>Note</aside><p>Bye.</p></div>"
    assert extract_text(page) == f"{LONG * 50}\n\n{LONG}\n\nBye."


def test_short_pages_are_kept():
    assert extract_text("<div class='menu'><a>m</a></div><p>Hello.</p><footer>f</footer>") == "Hello."


def brute_runs(weights, window, surge):
    """Every line from the first weight on that has a surge before or behind it without a whole empty window between."""
    n = len(weights)
    total = lambda i: sum(weights[i : i + window])
    top = max(map(total, range(n)), default=0)
    kept = []
    for i in range(n):
        together = [s for s in range(n) if total(s) >= min(surge, top) and all(total(k) for k in range(min(i, s), max(i, s) + 1))]
        back = [k for k in range(i + 1) if all(total(x) for x in range(k, i + 1))]
        if top and together and any(weights[k] for k in back):
            kept.append(i)
    return kept


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        weights = [rng.choice([0, 0, 0, 1, 5, 40, 90]) for _ in range(rng.randint(0, 25))]
        window, surge = rng.choice([1, 2, 3, 5]), rng.choice([1, 30, 86, 500])
        found = [i for s, e in runs_of(np.array(weights, np.int64), window, surge) for i in range(s, e)]
        assert found == brute_runs(weights, window, surge)


TEXT = "A sentence of the article that says something at length, as sentences of articles do. " * 3
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>linked item {i}</a></li>" for i in range(6)) + "</ul>"


def test_lists_of_links_inside_an_article_are_kept():
    got = extract_text(f"<nav>{LINKS}</nav><article><h1>T</h1><p>{TEXT}</p>{LINKS}<p>End words.</p></article><footer>{LINKS}</footer>")
    assert got.split("\n\n") == ["T", TEXT.strip(), *[f"linked item {i}" for i in range(6)], "End words."]


def test_a_sidebar_does_not_end_the_text():
    page = f"<h1>T</h1><p>{TEXT}</p><div class='sidebar'><p>{TEXT}</p></div><p>Short closing note.</p><footer><p>Imprint.</p></footer>"
    assert extract_text(page).split("\n\n") == ["T", TEXT.strip(), "Short closing note."]
    before = f"<p>Short opening note.</p><div class='sidebar'>{LINKS}</div><p>{TEXT}</p>"
    assert extract_text(before).split("\n\n") == ["Short opening note.", TEXT.strip()]


def test_names_of_articles_that_sound_like_comments():
    assert extract_text(f"<article class='comment-article'><p>{TEXT}</p></article>") == TEXT.strip()
    page = f"<article><p>{TEXT}</p></article><section class='comments'><article class='comment'><p>{TEXT}</p></article></section>"
    assert extract_text(page) == TEXT.strip()


def test_a_wrapper_with_most_of_the_text():
    assert extract_text(f"<div class='privacy'><p>{TEXT}</p></div><p>{TEXT[:150].strip()}</p>").split("\n\n") == [TEXT.strip(), TEXT[:150].strip()]
    # but not what stands beside a short article
    assert extract_text(f"<div class='ad'>{TEXT[:86]}</div><article><h1>Some words.</h1><p>{TEXT[:60]}</p></article>") == f"Some words.\n\n{TEXT[:60].strip()}"
