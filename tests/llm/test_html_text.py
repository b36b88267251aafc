import random
import re
from html import unescape
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import html_text as ht

P1 = "The first paragraph, long enough to count, tells of rivers, stones and light."
P2 = "The second paragraph, no shorter, goes on about paper, letters and a table."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=1>Home</a></ul></nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>(c) x</footer></body></html>",
        f"<body><header><h2>Site</h2><a href=/>x</a></header><div class='sidebar'><p>Sidebar, with words, and commas, and more</p></div><main><h1>Title</h1><p>{P1}<p>{P2}</main></body>",
        f"<div id=content><h1>Title</h1><div><p>{P1}</p></div><div class='ad'>Buy, now, cheap</div><p>{P2}</p></div><div class=comments><p>I agree, fully, yes, I do, always</p></div>",
        f"<div class=cookie-notice>We use cookies, many, many, of them, all of the time</div><article><h1>Title</h1><section><p>{P1}</p></section><form><p>Sign up, now</p></form><section><p>{P2}</p></section><section id='comments'><p>c, d, e</p></section></article>",
        f"<body><article><h1>Title</h1><script>var a='<p>no</p>'</script><style>p{{}}</style><p>{P1}<!-- <p>hidden</p> --></p><aside><p>More, of this</p></aside><p>{P2}</p><ul><li><a href=a>Related one</a><li><a href=b>Related two</a><li><a href=c>Three</a></ul></article></body>",
    ],
)
def test_article(page):
    assert ht.main_text(page) == f"Title {P1} {P2}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<br><hr>", ""),
        ("plain text", "plain text"),
        ("<p>a&amp;b &eacute;&#233; &lt;x&gt;", "a&b éé <x>"),
        ("<p>a  \n b<br>c</p><p>d", "a b c d"),
        ("<p>in<b>li</b>ne</p>", "inline"),
        ("<script>x", ""),
        ("<p>a < b <3</p>", "a < b <3"),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one two three"),
    ],
)
def test_small_pages(page, text):
    assert ht.main_text(page) == text


def test_headings_of_articles():
    assert ht.main_text(f"<div class='site-header'><p>Site, with words</p></div><article><div class='entry-header'><h1>Title</h1></div><header><h2>Sub</h2></header><p>{P1}</p></article>") == f"Title Sub {P1}"


def test_deep_and_long_pages():
    assert ht.main_text("<div>" * 20_000 + f"<p>{P1}" + "<b>" * 20_000) == P1
    assert len(ht.main_text("<article>" + f"<p>{P1}</p>" * 20_000)) == (len(P1) + 1) * 20_000 - 1
    assert ht.main_text('<a href="' * 3000) is not None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-divscript\n", max_size=200))
def test_never_fails(page):
    out = ht.main_text(page)
    assert out == " ".join(out.split())


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in ht.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = " ".join(x for x in (" ".join(unescape(b).split()) for b in re.split(r"<[^>]*>", article)) if x)
        assert r.text == want and r.n_chars == len(want)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, ht.extract(df).collect())) == sorted(["Row(page_id=1, url=None, text='', n_chars=0)"] * 2 + ["Row(page_id=None, url='u', text='x', n_chars=1)"])
    assert ht.extract(df.limit(0)).collect() == []


def test_short_sections_beside_a_long_one():
    """Without article or main, an introduction, conclusion and notes beside the longest section stay; link lists go."""
    long = "".join(f"<p>Paragraph {k} of the body, with commas, and more, words, than the rest of the page has.</p>" for k in range(8))
    links = "".join(f"<li><a href='/{k}'>Some other page {k}</a></li>" for k in range(6))
    page = f"<html><body><div><section><p>A short introduction, as it is.</p></section><section>{long}</section><p>Brief remark.</p><section><p>In short, it ends.</p></section><div><ul>{links}</ul></div><div class='footer'><p>All rights, reserved here.</p></div></div></body></html>"
    text = ht.main_text(page)
    assert text.startswith("A short introduction, as it is. Paragraph 0") and text.endswith("Brief remark. In short, it ends.")


BODY = "".join(f"<p>Paragraph {k} of the text, with commas, and words, as long as a paragraph of an article is.</p>" for k in range(6))
TEXT = " ".join(re.findall("<p>(.*?)</p>", BODY))


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize(
    "container",
    [
        "form id=aspnetForm",
        "form method=post action='/'",
        "div class='content has-sidebar'",
        "div class='no-sidebar'",
        "div class='side-by-side'",
        "div class='post comments-open'",
        "div class='modal-open page'",
        "div class='print area'",
        "div class='entry related-topic'",
        "div class='header-below'",
        "fieldset",
        "div role=form",
    ],
)
def test_containers_whose_names_only_seem_to_say_menu(container, inside):
    tag = container.split()[0]
    part = f"<{container}>{BODY}</{tag}>"
    middle = f"<article>{part}</article>" if inside else part
    page = f"<body><nav><a href=a>Home</a></nav>{middle}<div class='sidebar'><p>Beside, this, and that</p></div><div id=comments><p>I agree, fully.</p></div></body>"
    assert ht.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "site-footer", "cookie-notice", "cookieBanner", "ad-slot-300", "adsense", "comment-list", "related-posts", "share-buttons", "newsletter", "breadcrumbs", "siteNav", "promo box", "respond", "login-form"])
@pytest.mark.parametrize("key", ["class", "id"])
def test_marked_parts(name, key):
    page = f"<body><div class='page'><div class='content'>{BODY}</div><div {key}='{name}'><p>Words, of it, that are not, of the article, at all, ever.</p></div></div></body>"
    assert ht.main_text(page) == TEXT
    assert ht.main_text(f"<article>{BODY}<div {key}='{name}'><p>Words, of it.</p></div></article>") == TEXT


def test_long_comments_do_not_win():
    thread = "".join(f"<article class='comment' id='comment-{k}'><p>{P1} {P2} {P1}</p></article>" for k in range(9))
    for part in (f"<article><h1>Title</h1><p>{P1}</p></article>", f"<main><h1>Title</h1><p>{P1}</p></main>", f"<form><h1>Title</h1><p>{P1}</p></form>"):
        assert ht.main_text(f"<body>{part}<div class='comments'>{thread}</div></body>") == f"Title {P1}"


def test_unclosed_marked_parts():
    """A nav or header that is not closed holds the whole page."""
    for start in ("<nav><a href=a>Home</a>", "<header><a href=a>Home</a>", "<div class=sidebar>", "<aside>"):
        text = ht.main_text(f"<body>{start}<div id=main><h1>Title</h1>{BODY}</div></body>")
        assert text.endswith(f"Title {TEXT}")


def test_sections_in_rows():
    """Where nothing marks the whole, parts that are alike belong together, however deep."""
    rows = "".join(f"<div class=row><div class=text><p>Part {k}, of the text, which goes on, with words and commas.</p><p>Its second paragraph, number {k}, is here.</p></div></div>" for k in range(4))
    page = f"<body><div class=menu><a href=a>A</a></div><div id=all>{rows}</div><div class=side-bar-x><a href=1>One link</a><a href=2>Two links</a><a href=3>Three links</a></div></body>"
    assert ht.main_text(page) == " ".join(re.findall("<p>(.*?)</p>", rows))


def test_references_and_formulas_stay():
    links = "".join(f"<li><a href='https://example.org/{k}'>A title of a cited work that is as long as titles are, number {k}</a></li>" for k in range(5))
    page = f"<article>{BODY}<p>With <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> it ends.</p><table><tr><td><a href=1>One</a><td><a href=2>Two</a><td><a href=3>Three</a></table><ol>{links}</ol></article>"
    cited = " ".join(re.findall("<a[^>]*>(A title.*?)</a>", links))
    assert ht.main_text(page) == f"{TEXT} With x=1 it ends. One Two Three {cited}"
    assert ht.main_text(f"<article>{BODY}<svg width=1 /><p>{P1}</p><svg><text>no</text></svg></article>") == f"{TEXT} {P1}"


@pytest.mark.parametrize("unit", ["<svg>", "<script ", "<a 'x", "<template>x", "<p><button><b>", "<table><td><p>x<div>", "<li><b>", "</p><i></b>"])
def test_broken_pages_take_linear_time(unit):
    import time

    def seconds(n):
        began = time.process_time()
        ht.main_text(f"<article><p>{P1}</p><p><table>" + unit * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.5


# an independent scorer: the definition by recursion over a tree that Python's own parser makes of well-formed pages


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.top = self.at = ["html", "", [], None]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), [], self.at]
        self.at[2].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[2].append(data)


def brute(page):
    parser = _Tree()
    parser.feed(page)
    elements = []

    def visit(n):
        elements.append(n)
        for c in n[2]:
            if not isinstance(c, str):
                visit(c)

    visit(parser.top)
    inline = lambda c: not isinstance(c, str) and c[0] not in ht.BLOCK
    raw = lambda n: "".join(c if isinstance(c, str) else raw(c) if inline(c) else "" for c in n[2])
    flat = lambda s: " ".join(s.split())
    chars = lambda n: sum(len("".join(c.split())) if isinstance(c, str) else chars(c) for c in n[2])
    linked = lambda n: chars(n) if n[0] == "a" else sum(linked(c) for c in n[2] if not isinstance(c, str))
    links = lambda n: 1 if n[0] == "a" else sum(links(c) for c in n[2] if not isinstance(c, str))
    points = {id(n): 0.0 for n in elements}
    for n in elements[1:]:
        text = flat(raw(n))
        if n[0] in ht.PARAGRAPH and text:
            own = 1 + text.count(",") + min(len(text) / 100, 3)
            if n[0] in ("div", "section", "article"):
                points[id(n)] += own
            up = n
            for share in (1, 1 / 2, 1 / 6, 1 / 8):
                up = up[3]
                if up is None:
                    break
                points[id(up)] += own * share
    best, most = None, 0.0
    for n in elements:
        if n[0] in ht.CONTAINER and points[id(n)]:
            points[id(n)] *= (1 - linked(n) / chars(n) if chars(n) else 0.0) * (1.25 if n[0] in ("article", "main") else 1)
            if points[id(n)] > most + 1e-12:
                best, most = n, points[id(n)]

    def menu(n, short):
        return n[0] in ("ul", "ol", "div", "section") and links(n) >= 3 and linked(n) > 0.8 * chars(n) and (not short or linked(n) <= ht.MENU_LINK * links(n))

    def texts(n, short):
        out, held = [], []

        def walk(n):
            for c in n[2]:
                if isinstance(c, str):
                    held.append(c)
                elif menu(c, short):
                    continue
                elif inline(c):
                    walk(c)
                else:
                    flush()
                    walk(c)
                    flush()

        def flush():
            if flat("".join(held)):
                out.append(flat("".join(held)))
            held.clear()

        walk(n)
        flush()
        return out

    if best is None:
        return " ".join(texts(next((n for n in elements if n[0] == "body"), parser.top), False))
    above, n = [], best
    while n is not None:
        above.append(n)
        n = n[3]
    outer = [n for n in above if n[0] == "article"][:1] or [n for n in above if n[0] == "main"][-1:]
    if outer:
        best = outer[0]
    else:
        top = best
        for n in above:
            if n[0] in ("body", "html"):
                break
            beside = [c for c in n[3][2] if not isinstance(c, str) and c is not n and c[0] in ht.BLOCK and points[id(c)] > 0 and linked(c) < 0.25 * chars(c)]
            if any(c[:2] == n[:2] for c in beside) or 2 * sum(chars(c) - linked(c) for c in beside) >= chars(n) - linked(n):
                top = n[3]
        best = top
    kept = [best]
    if best[3] is not None and best[0] != "body":
        for c in best[3][2]:
            if isinstance(c, str) or c is best:
                continue
            few = linked(c) < 0.25 * chars(c)
            if c[0] in ht.BLOCK and points[id(c)] >= max(10, ht.SIBLING * most) or c[0] == "p" and chars(c) >= 80 and few:
                kept.append(c)
            elif best[0] == c[0] == "article" and points[id(c)] > 0 and few:
                kept.append(c)
            elif not outer and (c[0] in ht.BLOCK and (points[id(c)] > 0 or c[0] == "p") and few or c[0] in ("h1", "h2") and chars(c) and linked(c) < 0.5 * chars(c)):
                kept.append(c)
    kept.sort(key=lambda n: next(k for k, x in enumerate(elements) if x is n))
    return " ".join(x for n in kept for x in texts(n, best[0] in ("article", "main")))


def grown(rng, depth=0):
    """A random well-formed page without names."""
    words = lambda: " ".join(rng.choice(["river", "stone", "light, as", "paper", "it is", "table,"]) for _ in range(rng.choice([2, 6, 25, 60])))
    tag = rng.choice(["div", "section", "p", "p", "p", "ul", "h1", "h2", "blockquote", "article" if depth < 2 else "p", "main" if depth < 1 else "p"])
    link = lambda: f"<a href='x'>{words()}</a>"
    if tag in ("p", "h1", "h2"):
        return f"<{tag}>" + "".join(rng.choice([words, link, lambda: f"<b>{words()}</b>", words])() for _ in range(rng.randint(1, 3))) + f"</{tag}>"
    if tag == "ul":
        return "<ul>" + "".join(f"<li>{rng.choice([words, link])()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
    if depth > 3:
        return f"<p>{words()}</p>"
    inside = "".join(grown(rng, depth + 1) for _ in range(rng.randint(0, 4)))
    return f"<{tag} class='{rng.choice(['a', 'b'])}'>{inside}{words() if rng.random() < 0.1 else ''}</{tag}>"


def test_against_an_independent_scorer():
    rng, different = random.Random(8), set()
    for _ in range(1500):
        page = "<html><body>" + "".join(grown(rng) for _ in range(rng.randint(1, 4))) + "</body></html>"
        assert ht.main_text(page) == brute(page), page
        different.add(len(brute(page)))
    assert len(different) > 300


PROSE = "The river rises in the hills, runs past three mills, and meets the sea beyond the old harbour wall. "


@pytest.mark.parametrize("heading", ['<h2 id="search">Search here</h2>', '<h2 id="notifications">Notifications set</h2>', '<h3 id="navigation" class="nav-title">Navigation keys</h3>', '<h2 id="comments">Comments in code</h2>', '<h2 id="cookies"><a href="#cookies">Cookies jar</a></h2>'])
def test_ids_of_headings_are_words_of_theirs(heading):
    """Outlines give a heading the id of its words; the heading stays, with what is below it."""
    page = f"<html><body><nav><a href='/'>Home</a></nav><main><article><h1>Guide</h1><p>{PROSE * 3}</p>{heading}<p>{PROSE}</p></article></main><footer>End</footer></body></html>"
    words = re.sub("<[^>]*>", "", heading)
    assert ht.main_text(page) == " ".join(f"Guide {PROSE * 3} {words} {PROSE}".split())


@pytest.mark.parametrize("name", ["cookies", "search", "notifications", "menus", "login", "sharing", "widgets"])
def test_headed_sections_of_an_article_stay(name):
    page = f'<html><body><main><article><h1>Guide</h1><p>{PROSE * 3}</p><section id="{name}"><h2>On {name}</h2><p>{PROSE}</p></section><div id="{name}"><header><h3>More</h3></header><p>{PROSE}</p></div></article></main></body></html>'
    assert ht.main_text(page) == " ".join(f"Guide {PROSE * 3} On {name} {PROSE} More {PROSE}".split())


def test_headed_sections_of_readers_links_and_forms_go():
    bad = (
        f'<section id="comments"><h2>Comments</h2><p>{PROSE}</p></section>'
        f'<section id="related"><h2>Read on</h2><ul><li><a href="a">{PROSE}</a></li><li><a href="b">{PROSE}</a></li></ul></section>'
        f'<section id="newsletter"><h2>Letters</h2><p>{PROSE}</p><form><input name="mail"></form></section>'
        f'<section id="promo" class="promo-box"><h2>Buy</h2><p>{PROSE}</p></section>'
        f'<section id="sidebar"><p>{PROSE}</p></section>'
        f'<h2 id="x" hidden>Secret</h2><h2 style="display:none">Secret</h2>'
    )
    page = f"<html><body><main><article><h1>Guide</h1><p>{PROSE * 4}</p>{bad}<p>{PROSE}</p></article></main></body></html>"
    assert ht.main_text(page) == " ".join(f"Guide {PROSE * 4} {PROSE}".split())


def test_links_within_a_sentence_keep_their_words():
    page = f'<html><body><main><article><h1>Guide</h1><p>{PROSE} See <a class="tooltip-banner" href="x">the banner page</a> for more of it, please.</p><p><a class="banner" href="y">Win a prize</a></p><p>{PROSE}</p></article></main></body></html>'
    assert ht.main_text(page) == " ".join(f"Guide {PROSE} See the banner page for more of it, please. {PROSE}".split())


def test_all_articles_of_a_page():
    card = '<article><h2><a href="c">A card with a link and no more than it</a></h2></article>'
    page = f"<html><body><main><article><h2>One</h2><p>{PROSE * 5}</p></article><article><h2>Two</h2><p>{PROSE}</p></article>{card}</main></body></html>"
    assert ht.main_text(page) == " ".join(f"One {PROSE * 5} Two {PROSE}".split())


def test_references_in_main():
    links = "".join(f'<li><a href="r{k}">A report on the rivers of the north, part {k}</a></li>' for k in range(3))
    menu = "".join(f'<li><a href="m{k}">Part {k}</a></li>' for k in range(4))
    page = f"<html><body><main><h1>Guide</h1><p>{PROSE * 3}</p><ul>{menu}</ul><h2>References</h2><ul>{links}</ul></main></body></html>"
    assert ht.main_text(page) == " ".join(f"Guide {PROSE * 3} References {' '.join(f'A report on the rivers of the north, part {k}' for k in range(3))}".split())
