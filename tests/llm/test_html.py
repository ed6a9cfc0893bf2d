import re
import time

import pytest

from verdict.llm.html_text import Tree, composite_density, content_nodes, extract, extract_column, names_boilerplate

PROSE = "Plain prose with enough words to carry a paragraph of its own, and then some more of them."


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a><li><a href="/b">other</a></ul></nav><!-- ad --><div class="ad">Buy now.</div>
    <div class="cookie-notice">We use cookies</div>
    <article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp; line<br><p>{PROSE}<p>A&lt;b &#233;&#x41;
    <form>Name <input value="x"><button>Send</button></form><blockquote>Quote</blockquote>
    <section id="comments"><p>Nice read!</p></section></article><aside>Side</aside><footer>&copy; end</footer></body></html>"""
    assert extract(page) == f"Title & more\nFirst line\n{PROSE}\nA<b éA\nQuote"


def test_page_without_article():
    page = f'<body><div class="menu"><a href="#">x</a></div><div id="top"><a href="1">One</a> <a href="2">Two</a> <a href="3">Three</a></div><div id="content"><h1>Head</h1><p>{PROSE}</p><p>{PROSE} Again.</p><ul><li>Point</li></ul></div><div><a href="4">link list</a><a href="5">more links</a></div></body>'
    assert extract(page) == f"Head\n{PROSE}\n{PROSE} Again.\nPoint"


def test_odd_input():
    assert extract(None) == extract("") == extract("<nav>x</nav>") == extract("<article></article>") == ""
    assert extract("just  text\n here") == "just text here"
    assert extract("<p>a < b & c <3 d") == "a < b & c <3 d"
    assert extract('<article><p title="a > b">x</article>') == "x"
    assert extract("<article><p>unclosed <i") == "unclosed <i"
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert len(extract("<article>" + f"<p>{PROSE}</p>" * 20_000)) == 20_000 * (len(PROSE) + 1) - 1


def test_density_prefers_prose_over_links():
    tree = Tree(f"<body><div><a>{PROSE}</a><a>{PROSE}</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>")
    assert [tree.tag[k] for k in content_nodes(tree)] == ["div"] and content_nodes(tree)[0] == 5


def test_operator_over_table(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</article>", 7), (2, None, None, 7), (2, None, None, 7), (None, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extract_column(pages).collect()), key=str)
    assert got == sorted([(1, "u", PROSE, len(PROSE)), (2, None, "", 0), (2, None, "", 0), (None, "", "", 0)], key=str)
    assert extract_column(pages.limit(0)).count() == 0


def test_generated_shape():
    page = f'<!DOCTYPE html><html lang="en"><body><div class="ad">Advert.</div><article><h1>H</h1><p><b>One.<br><p>{PROSE}</p><p>Two.</p></article><footer>&copy; x &middot; y</footer></body></html>'
    inside = re.search("<article>(.*)</article>", page)[1]
    assert extract(page) == "\n".join(x for x in re.sub(r"<[^>]*>", "\n", inside).split("\n") if x)


def test_names_that_look_like_boilerplate_cost_no_content():
    page = f"""<article><p>{PROSE}</p><pre>x = 1 <span class="comment"># why</span></pre><section id="related-work"><p>Before us.</p></section>
    <div class="social-history">History.</div><div class="page-share-price">Price.</div><p class="ad-hoc">Hoc.</p><div class="share-buttons">tweet</div><ul class="related_posts"><li>Other</li></ul></article>"""
    assert extract(page) == f"{PROSE}\nx = 1 # why\nBefore us.\nHistory.\nPrice.\nHoc."
    form = f'<body><form id="page"><div class="navBar">menu</div><div><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></div><input value="q"><button>go</button></form><form>Search</form></body>'
    assert extract(form) == f"Head\n{PROSE}\n{PROSE}"


def test_pages_without_article_or_main():
    for k in range(40):
        body = [f"{PROSE} {n}." for n in range(2 + k % 5)]
        column = "<div><h1>Head</h1>" + "".join(f"<p>{b}</p>" for b in body) + "<p>Short end.</p></div>"
        column = column if k % 2 else f"<div><section>{column}</section></div>"
        links = "".join(f'<li><a href="/{n}">{PROSE[: 10 + n]}</a></li>' for n in range(k % 7 + 2))
        page = f"<html><body><div><ul>{links}</ul></div>{column}<div>{links}</div><footer>&copy; {PROSE}</footer></body></html>"
        assert extract(page) == "\n".join(["Head", *body, "Short end."]), k


def test_densities_against_brute_force():
    page = f"<body><div><ul><li><a>one</a><li><a>two</a></ul></div><div><h1>Head</h1><p>{PROSE} <a>link</a></p><div><p>{PROSE}<p>{PROSE}</div></div></body>"
    tree = Tree(page)
    n = len(tree.tag)

    def below(k):
        return [k, *(x for c in range(n) if tree.parent[c] == k for x in below(c))]

    def chars(nodes):
        return sum(len(" ".join(t.split())) for node, t in tree.pieces if t and node in nodes)

    body = tree.tag.index("body")
    in_links = {x for k in range(n) if tree.tag[k] == "a" for x in below(k)}
    ratio = chars(in_links) / chars(below(body))
    density = [composite_density(chars(below(k)), len(below(k)) - 1, chars(in_links & set(below(k))), sum(tree.tag[x] == "a" for x in below(k)), ratio) for k in range(n)]
    best = max(range(n), key=lambda k: (sum(density[c] for c in range(n) if tree.parent[c] == k), -k))
    assert best in content_nodes(tree) and extract(page) == f"Head\n{PROSE} link\n{PROSE}\n{PROSE}"


def test_cost_is_linear():
    pages = ['<div class="a b">' * 20_000 + "x", "<a " * 20_000, "<div>" * 20_000 + "</b>" * 20_000, '<a "<b>"' * 20_000, "<span>" * 20_000 + "</p>" * 20_000, "<ul><li>" * 10_000 + "</i>" * 20_000, "<div " + "class=a " * 20_000 + ">x", "<form>" * 20_000 + "x"]
    for page in pages:
        began = time.thread_time()
        extract(page)
        assert time.thread_time() - began < 5, page[:20]


LAYOUT = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>End.</p>"
OTHER = "<p>A reader or a seller goes on and on about something that has nothing to do with what the page is about.</p>" * 3


@pytest.mark.parametrize(
    "page",
    [
        f"<div id='header'><h2>Site</h2></div><div class='content'>{LAYOUT}</div><div id='footer'>All rights reserved by the owner of this page.</div>",
        f"<div class='post'>{LAYOUT}</div><ol class='commentlist'><li>{OTHER}</li><li>{OTHER}</li></ol>",
        f"<main>{LAYOUT}<section class='comments'><h3>Comments</h3>{OTHER}</section></main>",
        f"<article>{LAYOUT}</article><article class='comment'>{OTHER}</article>",
        f"<div>{LAYOUT}</div><ul class='reader-comments'><li>{OTHER}</li></ul><div class='topnav'><a href='/'>Home</a></div>",
        f"<div class='wrap'><div class='sidebarleft'>{OTHER}</div><div>{LAYOUT}</div></div>",
        f"<div class='cookie-banner'>{OTHER}</div><div class='site-notice'>{OTHER}</div><div id='main'>{LAYOUT}<div class='advert'>{OTHER}</div></div>",
        f"<div id='main'>{LAYOUT}<form><label>Your name, please</label><input><p>We never share it.</p></form></div>",
        f"<main><section><h1>Title</h1><p>{PROSE}</p></section><section><p>{PROSE} {PROSE}</p><p>End.</p></section></main><aside>{OTHER}</aside>",
        f"<table><tr><td class='menu'><a href='/'>Home</a><br><a href='/n'>News</a></td><td>{LAYOUT}</td></tr></table>",
    ],
)
def test_layouts(page):
    assert extract(f"<body>{page}</body>") == f"Title\n{PROSE}\n{PROSE} {PROSE}\nEnd."


def test_words_written_as_one():
    assert all(map(names_boilerplate, "commentlist sidebarleft navmenu topnav footerlinks".split()))
    assert not any(map(names_boilerplate, "address adhoc commentary navigator subscript shareholders mainstory noticeable".split()))
