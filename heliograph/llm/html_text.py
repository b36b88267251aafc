"""HTML extraction by tree scoring.

A page is parsed into a tree by a small tokenizer with the usual implied end
tags.  What never holds the article (scripts, buttons, media and the like) goes
first.  Other parts are judged by tag, role, class and id, and by the prose they
hold, that is the characters outside links:

* marked parts (nav, footer, aside, hidden ones, and those whose names say
  advert, menu, notice, sidebar, comments ...) are cut off, unless half of the page's prose
  and its main element or first heading are in them, as when a tag is not closed;
* doubtful parts (form, fieldset, header, and names that say both, as in
  ``entry related-topic``) are cut off, unless half of the prose around them is in them.

A name counts by the words that it is about: ``site-footer`` is a footer,
``has-sidebar``, ``no-sidebar`` and ``comments-open`` tell of a state.  Headings and links within a sentence
are not judged by name; parts of an article that begin with a heading and whose id alone is a marked word
(``<section id="cookies">``, as outlines make them) go only where half of them is links or a form is in them.

Each paragraph then passes points for its length and commas to its ancestors,
less with each level; a container's points are discounted by its link density.
The container with most points is kept, raised to the article or main element
around it, or else to the outermost one that holds siblings like it or half as much
prose again, and with it the siblings that score well; outside article and main, also those that
hold prose, however short.  Its text is given block by block, in page order;
all articles beside the best one are kept.
Lists and divisions that are nearly all links are menus and left out, inside of article
and main only where the links are short.

Defined cases: a null, empty or tag-only html gives an empty text; a page
without any scoring paragraph gives what is left of its body; ties go to the
container that opens first; unclosed tags close with their parent; a null url
stays null; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg annotation".split())
#: of these, those that are parsed on where no end tag follows, and may close themselves
OPEN = frozenset(("svg", "template", "annotation"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: what a start tag closes, if it is open and not behind a scope
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr"), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
KEEPS_P = frozenset(("option", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "body", "legend"))
SCOPE = frozenset(("table", "td", "th", "caption", "button", "object", "ul", "ol", "dl", "select"))
NEVER = frozenset("button select input menu dialog object embed audio video canvas map head annotation-xml".split()) | RAW
MARKED = frozenset(("nav", "footer", "aside"))
DOUBTFUL = frozenset(("form", "fieldset"))
ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: words that mark a part where a name is that word, ends in it, or begins with it before a word of SHAPES
NOUNS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsors sponsored promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription "
    "sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer share sharing social related recommended "
    "recommendations login signin signup register search pagination pager toolbar disclaimer copyright skip hidden tags "
    "comment comments commentlist disqus reply replies respond".split()
)
#: of these, those that mark a part wherever a name begins with them
PREFIXES = frozenset("ad ads advert adsense sponsor sponsored promo cookie cookies consent gdpr newsletter sidebar nav navbar breadcrumb breadcrumbs footer pagination comment comments disqus popup".split())
SHAPES = frozenset(
    "area bar block body box button buttons col column container content form group heading icons inner item items layer left links list main message news "
    "outer overlay pane panel popup posts articles stories region right row section stack strip text title toggle top bottom widget wrap wrapper".split()
)
#: first or last words of a name that tells of a state, or of another part
STATES = frozenset("has no not non with without is show hide open opened closed enabled disabled active inactive visible supported allowed on off ready above below before after".split())
#: names of the heading of a page, which is not that of an article
TOP = frozenset(("header", "masthead", "topbar"))
POSITIVE = frozenset("article content entry post story main body page text blog single".split())
SAFE = frozenset(("html", "body", "main", "article"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: of the nouns, those of what readers write
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: elements whose names are judged
NAMED = BLOCK | {"span", "a", "ins", "small", "label"}
PARAGRAPH = frozenset(("p", "td", "pre", "blockquote", "li", "dd", "div", "section", "article", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINER = frozenset("div section article main body td table blockquote center details dd".split())
#: characters, on average, that the links of a menu have at most
MENU_LINK = 24
#: share of the points of the best container that a sibling needs
SIBLING = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "attributes")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.cut, self.points = False, 0.0


def parse(html: str) -> Node:
    """The tree of a page; texts are decoded."""
    root = Node("html", None)
    #: the open elements, and by tag their places
    stack, opened = [root], {"html": [0]}
    scopes: list[int] = []
    unclosed: set[str] = set()
    at, end, last = 0, len(html), html.rfind(">")

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag].pop()
        while scopes and scopes[-1] >= depth:
            scopes.pop()

    def close(names: tuple[str, ...]) -> None:
        """Close the innermost of the names above the last scope."""
        k = max((opened[n][-1] for n in names if opened.get(n)), default=0)
        low = scopes[-1] if scopes else 0
        if k > low or k and k == low and stack[low].tag in names:
            pop_to(k)

    while at < end:
        if at > last:  # no tag can end any more
            rest = html[at:] if not html.startswith("<!--", at) else ""
            stack[-1].children.append(unescape(rest))
            break
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m[1] or m[4]:
            if opened.get(name) and name != "html":
                pop_to(opened[name][-1])
            elif name == "br":
                stack[-1].children.append(" ")
            continue
        if name == "html":
            continue
        if name in BLOCK and name not in KEEPS_P and opened.get("p"):
            close(("p",))
        if name in CLOSES:
            close(CLOSES[name])
            if name == "tr" or name in ("tbody", "tfoot", "thead"):
                close(("tr",))
        node = Node(name, stack[-1], (m[3] or m[6] or ""))
        stack[-1].children.append(node)
        shut = (m[3] or "").endswith("/")
        if name in RAW:
            if shut and name in OPEN:
                continue
            stop = None if name in unclosed else END[name].search(html, at)
            if stop is None:
                unclosed.add(name)
                at = end if name not in OPEN else at
            else:
                close_at = html.find(">", stop.end())
                at = end if close_at < 0 else close_at + 1
        elif name not in VOID and not shut or name in BLOCK and name != "hr":
            opened.setdefault(name, []).append(len(stack))
            stack.append(node)
            if name in SCOPE:
                scopes.append(len(stack) - 1)
    return root


END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _about(name: str) -> tuple[bool, bool, bool]:
    """Whether a class or id marks a part, the heading of a page, or what may be the article."""
    words = [w.lower() for w in WORDS.findall(name)]
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    if not words or words[0] in STATES or words[-1] in STATES:
        return False, False, False
    first, last = words[0], words[-1]
    marks = last in NOUNS or first in PREFIXES or first in NOUNS and all(w in SHAPES for w in words[1:])
    return marks, last in TOP, not marks and any(w in POSITIVE for w in words) and all(w in POSITIVE or w in SHAPES for w in words)


def _grade(node: Node, inside: bool) -> int:
    """0: kept, 1: doubtful, 2: marked; inside: of an article or main element."""
    tag, found = node.tag, {}
    if tag in HEADINGS and node.attributes:  # a heading's id is made of its words
        return 2 if HIDDEN_TAG.search(node.attributes) else 0
    out = 2 if tag in MARKED else 1 if tag in DOUBTFUL or tag == "header" and not inside else 0
    if node.attributes and not node.attributes.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(node.attributes)}
    if not found:
        return out
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in ROLES or HIDDEN.search(found.get("style", "")):
        return 2
    if role in ("form", "banner"):
        out = max(out, 1)
    if tag in SAFE or tag not in NAMED:
        return out
    if tag == "a" and _in_sentence(node):
        return out
    about = [_about(name) for name in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if any(x[0] for x in about):
        if inside and tag in ("section", "div") and _headed(node) and not any(_about(name)[0] for name in found.get("class", "").split()) and not READERS & {w.lower() for w in WORDS.findall(found["id"])}:
            return out or UNSURE
        return 1 if any(x[2] for x in about) else 2
    return max(out, 1) if not inside and any(x[1] for x in about) else out


#: a grade of headed sections of an article whose id alone is a marked word, as documents that were made from outlines have them: their links and forms decide
UNSURE = -1
HIDDEN_TAG = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)


def _headed(node: Node) -> bool:
    """Whether a part begins with a heading, be it in a header of its own."""
    for c in node.children:
        if isinstance(c, Node):
            return c.tag in HEADINGS or c.tag in ("header", "hgroup") and _headed(c)
        if c.strip():
            return False
    return False


def _has_form(node: Node) -> bool:
    todo = [node]
    while todo:
        below = [c for c in todo.pop().children if isinstance(c, Node)]
        if any(c.tag in ("form", "input", "textarea") for c in below):
            return True
        todo += below
    return False


def _in_sentence(node: Node) -> bool:
    """Whether words stand beside an inline element in its parent."""
    return any(isinstance(c, str) and len(c.split()) > 1 for c in node.parent.children)


HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _walk(root: Node) -> list[Node]:
    """All elements that are not cut off, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in NEVER:
            node.cut = True
        if node.cut:
            continue
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _cut_off(root: Node) -> list[Node]:
    """Cut off marked parts, then doubtful ones; the elements that are left."""
    nodes = _walk(root)
    scope: dict[Node, Node] = {}  # the article or main element around each, or the page
    grades: dict[Node, int] = {}
    for node in nodes:
        up = node.parent
        scope[node] = root if up is None else up if up.tag in ("article", "main") else scope[up]
        grades[node] = 0 if up is None else _grade(node, scope[node] is not root)
    for grade in (2, 1, UNSURE):
        if grade not in grades.values():
            continue
        lengths = _lengths(nodes)
        if grade == UNSURE:
            for node in nodes:
                if grades[node] == UNSURE and not node.parent.cut:
                    total, linked, _ = lengths[node]
                    node.cut = 2 * linked >= total or _has_form(node)
                else:
                    node.cut = node.parent is not None and node.parent.cut
            nodes = [n for n in nodes if not n.cut]
            continue
        heads: dict[Node, int] = {}
        articles: dict[Node, int] = {}
        first = next((n for n in nodes if n.tag == "h1"), None)
        for node in reversed(nodes):
            below = [c for c in node.children if isinstance(c, Node) and c in heads]
            heads[node] = (node.tag == "main" or node is first) + sum(heads[c] for c in below)
            articles[node] = (node.tag in ("article", "main") and grades[node] < 2) + sum(articles[c] for c in below)
        for node in nodes:
            if grades[node] != grade or node.parent.cut:
                node.cut = node.parent is not None and node.parent.cut
                continue
            (total, linked, _), (all_total, all_linked, _) = lengths[node], lengths[scope[node]]
            holds = total > linked and 2 * (total - linked) >= all_total - all_linked
            if grade == 2:
                holds = holds and heads[node] > 0
            elif scope[node] is root:
                holds = holds and (articles[node] > 0 or articles[root] == 0)
            node.cut = not holds
        nodes = [n for n in nodes if not n.cut]
    return nodes


def _lengths(nodes: list[Node]) -> dict[Node, tuple[int, int, int]]:
    """Visible characters, those inside links, and links, of each element."""
    out: dict[Node, tuple[int, int, int]] = {}
    for node in reversed(nodes):
        total = linked = links = 0
        for c in node.children:
            if isinstance(c, str):
                total += len("".join(c.split()))
            elif not c.cut and c in out:
                a, b, n = out[c]
                total, linked, links = total + a, linked + b, links + n
        if node.tag == "a":
            linked, links = total, 1
        out[node] = (total, linked, links)
    return out


def _own_text(node: Node) -> str:
    """The text of a paragraph: its own and that of inline elements in it."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.cut and c.tag not in BLOCK:
            todo += reversed(c.children)
    return " ".join("".join(parts).split())


def _blocks(top: Node, lengths: dict, in_article: bool) -> Iterator[str]:
    """The texts of the blocks below top, in page order."""
    parts: list[str] = []
    todo: list[Node | str | None] = [None, *reversed(top.children)]
    while todo:
        c = todo.pop()
        if c is None:
            text = " ".join("".join(parts).split())
            parts = []
            if text:
                yield text
        elif isinstance(c, str):
            parts.append(c)
        elif c.cut or c.tag in ("ul", "ol", "div", "section") and _is_menu(lengths.get(c), in_article):
            continue
        elif c.tag in BLOCK:
            todo.append(None)
            todo += reversed(c.children)
            todo.append(None)
        elif c.tag == "br":
            parts.append(" ")
        else:
            todo += reversed(c.children)


def _is_menu(length: tuple[int, int, int] | None, in_article: bool) -> bool:
    """Nearly all links; in an article the links of a menu are also short, unlike those of a list of references."""
    return length is not None and length[2] >= 3 and length[1] > 0.8 * length[0] and (not in_article or length[1] <= MENU_LINK * length[2])


def _class(node: Node) -> str:
    found = CLASS.search(node.attributes or "")
    return found[0] if found else ""


CLASS = re.compile(r"""\bclass\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def _raised(best: Node, lengths: dict) -> Node:
    """The outermost container around best with siblings like the branch that holds best, or with half as much prose again."""
    top = node = best
    while node.parent is not None and node.tag not in ("body", "html"):
        own, more, alike = lengths[node], 0, False
        for c in node.parent.children:
            if isinstance(c, Node) and c is not node and c in lengths and c.tag in BLOCK:
                total, linked, _ = lengths[c]
                if c.points > 0 and linked < 0.25 * total:
                    more += total - linked
                    alike = alike or c.tag == node.tag and _class(c) == _class(node)
        if alike or 2 * more >= own[0] - own[1]:
            top = node.parent
        node = node.parent
    return top


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    root = parse(html)
    nodes = _cut_off(root)
    lengths = _lengths(nodes)
    order = {n: k for k, n in enumerate(nodes)}
    for node in nodes:
        if node.tag in PARAGRAPH and node.parent is not None:
            text = _own_text(node)
            if not text:
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            up, level = node.parent, 1
            if node.tag in ("div", "section", "article"):
                node.points += points
            while up is not None and level <= 4:
                up.points += points / level if level < 3 else points / (2 * level)
                up, level = up.parent, level + 1
    best, most = None, 0.0
    for node in nodes:
        if node.points and node.tag in CONTAINER:
            total, linked, _ = lengths[node]
            score = node.points * (1 - linked / total) if total else 0.0
            if node.tag in ("article", "main"):
                score *= 1.25
            node.points = score
            if score > most:
                best, most = node, score
    if best is None:
        body = next((n for n in nodes if n.tag == "body"), root)
        return " ".join(_blocks(body, lengths, False))
    up, found = best, None
    while up is not None:
        if up.tag in ("article", "main"):
            found = up
            if up.tag == "article":
                break
        up = up.parent
    best = found or _raised(best, lengths)
    in_article = best.tag in ("article", "main")
    kept = [best]
    if best.parent is not None and best.tag != "body":
        for c in best.parent.children:
            if isinstance(c, Node) and c is not best and not c.cut and c in order:
                total, linked, _ = lengths[c]
                good = c.points >= max(10, SIBLING * most) and c.tag in BLOCK
                prose = c.tag == "p" and total >= 80 and linked < 0.25 * total
                # where no article or main marks the whole, parts beside the best one that hold prose belong to it, however short
                part = found is None and (c.points > 0 or c.tag == "p") and c.tag in BLOCK and linked < 0.25 * total
                also = best.tag == c.tag == "article" and c.points > 0 and linked < 0.25 * total  # a page may hold several
                heading = c.tag in ("h1", "h2") and found is None and total > 0 and linked < 0.5 * total
                if good or prose or part or heading or also:
                    kept.append(c)
    kept.sort(key=order.__getitem__)
    return " ".join(x for n in kept for x in (_blocks(n, lengths, in_article)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
