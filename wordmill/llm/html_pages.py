"""Labelled pages to train the content model on, made from layouts.

A layout is a nested list: (tag, attributes, label, children), where a child may be a
number of words of text. Labels: B boilerplate, C content, M a holder of both. A text has
its element's label (C in a holder, unless it is given as a "#text" of its own). The layouts
name the usual parts of pages in the usual ways, and now and then use a word of such a name
inside a longer one that means something else; words are drawn at random, so that the model
learns structure, names and lengths.
"""

from __future__ import annotations

import random

B, C, M = 0, 1, 2

Node = tuple[str, str, int, list]

#: Names that sites give to parts that are not the article, by the element they stand on.
SIDE_NAMES = (
    "nav menu navbar navigation breadcrumb breadcrumbs toc pagination header site-header masthead banner footer site-footer copyright legal sidebar side widget "
    "ad ads advert advertisement ad-slot sponsor sponsored promo promotion cookie cookie-notice consent notice alert popup modal overlay newsletter subscribe signup "
    "form search login comments comment comment-list respond replies disqus share sharing social related recommended more-stories tags meta skip-link"
).split()
MAIN_NAMES = "article content main post entry entry-content post-content article-body story story-body main-content text body-text".split()


#: Further words that make up names.
OTHER_WORDS = "page top left block box area wrap inner list item row col big new of the my history engines guide law story about center".split()
_LINE_BREAK: Node = ("br", "", C, [])


def _compound(r: random.Random, names: list[str], length: int) -> str:
    """A name of several words, one of them from ``names``."""
    parts = [r.choice(OTHER_WORDS) for _ in range(length - 1)]
    parts.insert(r.randint(0, len(parts)), r.choice(r.choice(names).split("-")))
    return r.choice("-_").join(parts)


def _named(r: random.Random, names: list[str]) -> str:
    kind = r.random()
    name = r.choice(names) if kind < 0.8 else _compound(r, names, 2 if kind < 0.95 else 3)
    return name + (f" {r.choice(OTHER_WORDS)}" if r.random() < 0.2 else "")


def _plain_attrs(r: random.Random) -> str:
    """Names on parts of an article, mostly none; a few hold a word that elsewhere names a side part."""
    kind = r.random()
    if kind < 0.84:
        return ""
    return "class=" + (r.choice(OTHER_WORDS) if kind < 0.9 else _compound(r, SIDE_NAMES, r.choice([2, 3, 3, 3, 4])) if kind < 0.97 else _compound(r, MAIN_NAMES, 2))


def _link_list(r: random.Random, label: int = B) -> Node:
    return ("ul", "", label, [("li", "", label, [("a", "", label, [r.randint(1, 3)])]) for _ in range(r.randint(2, 8))])


def _prose(r: random.Random) -> list:
    def paragraph() -> Node:
        n = r.choice([1, 2, 3, 4, 6, 8, 12, 20, 40, 60, 90, 150])
        parts: list = [n]
        if r.random() < 0.3:
            parts.append((r.choice(["b", "i", "em", "strong", "span", "code"]), "", C, [r.randint(1, 6)]))
        if r.random() < 0.25:
            parts += [("a", "", C, [r.randint(1, 4)]), r.randint(1, 30)]
        if r.random() < 0.15:
            parts += [_LINE_BREAK, r.randint(1, 40)]
        if r.random() < 0.2:
            parts += [r.choice([("math", "", C, [(t, "", C, [1]) for t in ("mi", "mo", "mi")]), ("abbr", "", C, [1]), ("time", "", C, [2]), ("q", "", C, [r.randint(2, 9)]), ("video", "", C, [2]), ("svg", "", C, [("g", "", C, [])])]), r.randint(1, 9)]
        if r.random() < 0.15:
            parts += [r.choice([("select", "", B, [("option", "", B, [1]) for _ in range(r.randint(1, 4))]), ("button", "", B, [r.randint(1, 2)]), ("input", "", B, []), ("label", "", B, [2])]), r.randint(1, 9)]
        return ("p", _plain_attrs(r), C, parts)

    out: list = [paragraph() for _ in range(r.randint(1, 9))]
    for _ in range(r.randint(0, 5)):
        out.insert(r.randint(0, len(out)), r.choice([
            ("h2", "", C, [r.randint(1, 7)]), ("h3", "", C, [r.randint(1, 7)]), ("blockquote", "", C, [paragraph()]), ("pre", "", C, [r.randint(3, 40)]),
            ("ul", "", C, [("li", "", C, [r.randint(1, 20)]) for _ in range(r.randint(2, 7))]), ("ul", "", C, [("li", "", C, [r.randint(1, 3)]) for _ in range(r.randint(2, 7))]), ("ol", "", C, [("li", "", C, [r.randint(3, 25)]) for _ in range(3)]),
            ("table", "", C, [("tr", "", C, [("td", "", C, [r.randint(1, 4)]) for _ in range(3)]) for _ in range(3)]),
            ("figure", "", C, [("figcaption", "", C, [r.randint(3, 14)])]), ("div", _plain_attrs(r), C, [paragraph()]), ("section", _plain_attrs(r), C, [("h2", "", C, [3]), paragraph()]), ("p", "", C, [("img", "", C, [])]),
            ("div", _plain_attrs(r), C, [r.randint(5, 60), _LINE_BREAK, _LINE_BREAK, r.randint(5, 60)]),
            ("b", "", C, [paragraph(), r.randint(1, 9)]), r.randint(3, 30),
        ]))
    return out


def _side(r: random.Random) -> Node:
    """A part that is not the article, known by its element or by its name."""
    if r.random() < 0.45:
        tag, name = r.choice(["nav", "header", "footer", "aside", "form", "menu", "dialog", "button"]), r.choice(["", "", _named(r, SIDE_NAMES)])
    else:
        tag, name = r.choice(["div", "div", "div", "section", "section", "ul", "ol", "p", "span"]), _named(r, SIDE_NAMES)
    attrs = f"{r.choice(['class', 'class', 'id', 'role'])}={name}" if name else ""
    if tag in ("div", "section", "ol") and r.random() < 0.25:
        return _comments(r, tag)
    if tag == "ul":
        return ("ul", attrs, B, _link_list(r)[3])
    if tag in ("p", "span", "button"):
        return (tag, attrs, B, [r.randint(1, 25)])
    inside: list = []
    for _ in range(r.randint(1, 3)):
        inside.append(r.choice([
            _link_list(r), ("p", "", B, [r.choice([2, 5, 12, 25, 60, 100])]), r.choice([3, 8, 20, 40]), ("a", "", B, [2]),
            ("div", "", B, [("p", "", B, [r.randint(3, 50)]), ("a", "", B, [1])]), ("h3", "", B, [2]), ("label", "", B, [2]), ("b", "", B, [3]),
            ("ul", "", B, [("li", "", B, [("p", "", B, [r.randint(4, 40)])]) for _ in range(3)]), ("img", "", B, []), ("input", "", B, []), ("br", "", B, []),
        ]))
    return (tag, attrs, B, inside)


def _comments(r: random.Random, tag: str) -> Node:
    """What readers wrote: prose like the article's, under a name of its own."""
    each = lambda: (r.choice(["div", "li", "section"]), r.choice(["", "class=comment", "class=reply"]), B, [*([("b", "", B, [2])] if r.random() < 0.5 else []), *(("p", "", B, [r.choice([4, 12, 30, 60, 100])]) for _ in range(r.randint(1, 2)))])
    loose = lambda: ("p", "", B, [r.choice([4, 12, 30, 60])])
    inside = [r.choice([each, loose])() for _ in range(r.randint(1, 6))]
    heading = [(r.choice(["h2", "h3", "h4"]), "", B, [r.randint(1, 3)])] if r.random() < 0.7 else []
    return (tag, f"{r.choice(['class', 'id'])}={r.choice(['comments', 'comment-list', 'replies', 'respond', 'comments', 'disqus', 'responses', 'post-comments', 'comments-area'])}", B, heading + inside)


def _bare(r: random.Random) -> list:
    """Prose without an article around it: in the body, in a plain division or without any markup."""
    words = lambda: r.choice([2, 6, 20, 60, 150, 400])
    kind = r.random()
    if kind < 0.2:
        return [("#text", "", C, [words()])]
    if kind < 0.5:
        inside: list = [words()]
        for _ in range(r.randint(0, 4)):
            inside += [*[_LINE_BREAK] * r.randint(1, 2), words()]
    else:
        inside = _prose(r)
    holder = r.random()
    body = inside if holder < 0.5 else [("div", _plain_attrs(r), C, inside)]
    top = ("body", "", r.choice([C, M]), body)
    return [top] if r.random() < 0.4 else [("html", "", M, [*([("head", "", B, [])] if r.random() < 0.5 else []), top])] if r.random() < 0.7 else body


def labelled_page(r: random.Random) -> list:
    """What stands in the page, at its top."""
    if r.random() < 0.22:
        return _bare(r)
    heading: list = [("h1", "", C, [r.randint(2, 10)])]
    body = heading + _prose(r)
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
        body.insert(r.randint(1, len(body)), _side(r))
    if r.random() < 0.2:
        body.append(_comments(r, r.choice(["div", "section", "ol", "aside"])))
    kind = r.random()
    if kind < 0.5:
        article: list = [("article", r.choice(["", f"class={r.choice(MAIN_NAMES)}"]), C, body)]
    elif kind < 0.65:
        article = [("main", "", C, body)]
    elif kind < 0.8:
        article = [(r.choice(["div", "section", "td"]), f"{r.choice(['class', 'id'])}={_named(r, MAIN_NAMES)}", C, body)]
    elif kind < 0.85:
        article = [("div", _plain_attrs(r), C, body)]
    else:
        article = body
    if r.random() < 0.3 and kind < 0.9:
        article = [(r.choice(["div", "main", "section"]), r.choice(["", "class=container", "id=page", "class=wrapper"]), M, [*article, *[_side(r) for _ in range(r.randint(0, 2))]])]
    before, after = [_side(r) for _ in range(r.randint(0, 3))], [_side(r) for _ in range(r.randint(0, 3))]
    stray = [("#text", "", B, [r.randint(1, 8)])] if r.random() < 0.03 else []
    return [("html", "", M, [("head", "", B, []), ("body", "", M, [*before, *article, *after, *stray])])]


def training_pages(n: int = 2500, seed: int = 6) -> list[list]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
