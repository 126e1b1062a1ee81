"""A forgiving HTML reader: pages become trees of elements and text leaves.

Text leaves are nodes like elements. Raw-text elements (scripts, styles and the like) keep
their text out of the tree; drawings, formulas, media and templates are elements like any
other. Ends that HTML leaves out are supplied: an open paragraph ends where a block begins,
an open drawing or formula too, list items, cells and options end where their like begins,
and what is open at the end of the page is closed.
"""

from __future__ import annotations

import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements of other vocabularies: a slash ends an element inside, and any of ``_BREAKS_OUT`` ends them, unless one of ``_HTML_INSIDE`` lies between.
FOREIGN = frozenset("svg math".split())
_HTML_INSIDE = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr".split())
_BREAKS_OUT = BLOCK | frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())
#: A new element of the key ends an open one of the value, unless a holder lies between.
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_HOLDERS = frozenset("ul ol dl table menu article section div main aside nav form body html blockquote".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>?"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\s(hidden)(?=[\s/]|$)", re.I | re.S)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in RAW}

#: What stands in a page's sequence where a block begins or ends, and for a line break.
BREAK, SPACE = -1, -2


class Page:
    """Nodes in page order; node 0 is the page itself.

    ``parent``, ``name`` (None for text), ``attrs`` (the interesting attributes, lower case)
    and ``text`` have an entry per node; ``sequence`` holds text nodes, BREAK and SPACE.
    """

    __slots__ = ("parent", "name", "attrs", "text", "sequence")

    def __init__(self, html: str) -> None:
        self.parent, self.name, self.attrs, self.text, self.sequence = [-1], ["#page"], [""], [""], []
        open_: list[int] = [0]
        foreign = [False]  # of each open element: whether what it holds is of another vocabulary
        opened: Counter[str] = Counter()  # how many elements of a tag are open
        name, sequence = self.name, self.sequence

        def add(kind: str | None, attrs: str, text: str) -> int:
            self.parent.append(open_[-1])
            name.append(kind)
            self.attrs.append(attrs)
            self.text.append(text)
            return len(name) - 1

        def close_to(depth: int) -> None:
            while len(open_) > depth:
                tag = name[open_.pop()]
                opened[tag] -= 1
                if tag in BLOCK:
                    sequence.append(BREAK)
            del foreign[depth:]

        def break_out() -> None:
            depth = len(open_)
            while foreign[depth - 1]:
                depth -= 1
            close_to(depth)

        def find(names: frozenset[str] | set[str], holders: frozenset[str]) -> int:
            """Depth of the innermost open element of ``names``; 0 if a holder comes first."""
            if not any(opened[n] for n in names):
                return 0
            for d in range(len(open_) - 1, 0, -1):
                n = name[open_[d]]
                if n in names:
                    return d
                if n in holders:
                    return 0
            return 0

        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.match(html, at)
            if m is None:  # a tag that never ends, or an odd quote in one
                stop = html.find(">", at)
                at = size if stop < 0 else stop + 1
                continue
            at = m.end()
            if (text := m["text"]) is not None:
                sequence.append(add(None, "", text))
                continue
            if m["name"] is None:
                continue
            tag = m["name"].lower()
            if m["end"]:
                if tag in ("p", "br"):
                    break_out()
                d = find({tag}, frozenset())
                if d:
                    close_to(d)
                elif tag == "p":
                    sequence.append(BREAK)
                continue
            if tag in _BREAKS_OUT:
                break_out()
            if tag in _CLOSES_P and (d := find({"p"}, _HOLDERS | {"td", "th", "li", "button"})):
                close_to(d)
            if tag in _LIKE and (d := find(_LIKE[tag], _HOLDERS)):
                close_to(d)
            if tag in BLOCK:
                sequence.append(BREAK)
            elif tag in ("br", "option"):
                sequence.append(SPACE)
            if tag in RAW:
                if not m["attrs"].endswith("/") or (tag in ("script", "style", "title", "textarea") and not foreign[-1]):
                    stop = _RAW_END[tag].search(html, at)
                    at = stop.end() if stop else size
                continue
            found = m["attrs"]
            attrs = " ".join(f"{a[0] or a[4]}={a[1] or a[2] or a[3]}" for a in _ATTR.findall(found)).lower() if found else ""
            node = add(tag, attrs, "")
            if tag not in VOID and not (m["attrs"].endswith("/") and (tag in FOREIGN or foreign[-1])):
                open_.append(node)
                foreign.append(tag in FOREIGN or (foreign[-1] and tag not in _HTML_INSIDE))
                opened[tag] += 1
        sequence.append(BREAK)
