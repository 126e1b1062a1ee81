"""Main text of web pages by a tree-structured graphical model over the DOM.

Each node (element or text) has a hidden state: boilerplate, content, or a holder of both.
Potentials connect a node with its parent, and each node with what is seen of it: its
tag together with how much of its text is link text, the kind of its class, id or role names,
and how long its text is. Sum-product messages go up from the leaves and back down from the root;
the marginal of each text being content decides. All potentials are conditional
frequencies counted on labelled pages.

Messages are exact on a tree, and are passed for all nodes of the same depth of a whole
slice of pages at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordmill.llm.arrow_slices import slices
from wordmill.llm.html_pages import MAIN_NAMES, SIDE_NAMES, Node, training_pages
from wordmill.llm.html_tree import BREAK, SPACE, Page
from wordmill.llm.shipping import ship

STATES = 3
CONTENT = 1
_SMOOTH = 0.05
#: A hidden element's children can't be read by a visitor.
_HIDDEN = re.compile(r"(^| )(hidden=|aria-hidden=true|style=[^=]*(display\s*:\s*none|visibility\s*:\s*hidden))")
_WORDS = re.compile(r"[a-z]+")
_TOKENS = re.compile(r"[a-z][a-z_-]*")
_VALUES = re.compile(r"(?:class|id|role|itemprop|aria-label)=")
_SIDE_NAMES = frozenset(SIDE_NAMES) | frozenset("cookies comments advertising banners footers headers reply reviews responses subscription contentinfo complementary sidebars popups".split())
_SIDE = frozenset(w for n in _SIDE_NAMES for w in n.split("-")) - {"body", "site", "more", "list", "link", "slot"}
_MAIN_NAMES = frozenset(MAIN_NAMES) - {"body"} | {"articlebody"}
_MAIN = frozenset(w for n in _MAIN_NAMES for w in n.split("-")) - {"body"}
#: What an element's names say: nothing; a side part's own name, two words with one of its, more
#: words with one of its; the same for the main part; words of both; that it is hidden.
_NAMES = ("none", "side", "side2", "side3", "main", "main2", "main3", "both", "hidden")
_TAGS = (
    "#text #page html head body nav header footer aside form menu dialog button label article main section div p span a b ul li table tr td h1 h2 h3 blockquote pre figure figcaption br img other"
).split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_ALIKE = {"h4": "h3", "h5": "h3", "h6": "h3", "i": "b", "em": "b", "strong": "b", "u": "b", "code": "b", "ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "th": "td", "tbody": "table", "thead": "table", "tfoot": "table", "fieldset": "form", "input": "button", "select": "button", "option": "button", "optgroup": "button", "legend": "label", "center": "div", "hr": "br", "wbr": "br", "picture": "figure", "font": "span", "small": "span"}


#: How a node is related to its parent: as a part, as a text, or as a piece of prose.
_RELATION = np.array([1 if t == "#text" else 2 if t in "p h1 h2 h3 blockquote pre ul li table tr td figure figcaption".split() else 0 for t in _TAGS])
#: Values of a block's share of link text: none or little, some, most, no text, not asked.
_LINK_VALUES = 5
_INLINE = np.isin(np.array(_TAGS), ["#text", "span", "a", "b"])


def _name_kind(attrs: str) -> int:
    if not attrs:
        return 0
    if _HIDDEN.search(attrs):
        return _NAMES.index("hidden")
    found: set[str] = set()
    for token in _TOKENS.findall(_VALUES.sub(" ", attrs)):
        words = _WORDS.findall(token)
        if token in _SIDE_NAMES or token.replace("_", "-") in _SIDE_NAMES:
            found.add("side")
        elif token in _MAIN_NAMES or token.replace("_", "-") in _MAIN_NAMES:
            found.add("main")
        else:
            side, main, size = not _SIDE.isdisjoint(words), not _MAIN.isdisjoint(words), "2" if len(words) < 3 else "3"
            found |= {"both"} if side and main else {f"side{size}"} if side else {f"main{size}"} if main else set()
    return next((i for i, n in enumerate(_NAMES) if n in found), 0)


def _length_bucket(words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([1, 4, 10, 25, 60]), words, "right")


class Forest:
    """The nodes of many pages as arrays; ``levels`` are node places by depth, from 0."""

    def __init__(self, pages: list[tuple[list[int], list[int], list[int], list[int]]]) -> None:
        """Per page: parent place (-1 for the root), tag, name kind and number of words of each node."""
        sizes = np.array([len(p[0]) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        base = np.repeat(self.first[:-1], sizes)
        flat = lambda k: np.fromiter((v for p in pages for v in p[k]), dtype=np.int64, count=int(sizes.sum()))
        parent = flat(0)
        self.tag, self.kind, words = flat(1), flat(2), flat(3)
        self.relation = _RELATION[self.tag]
        self.parent = np.where(parent < 0, -1, parent + base)
        depth = np.zeros(len(parent), dtype=np.int64)
        here, levels = np.flatnonzero(self.parent < 0), []
        # children follow their parents, so a node's level is known once its parent's is
        order = np.argsort(self.parent, kind="stable")
        starts = np.searchsorted(self.parent[order], np.arange(len(parent) + 1))
        while len(here):
            levels.append(here)
            counts = starts[here + 1] - starts[here]
            at = np.repeat(starts[here] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            here = order[at]
            depth[here] = len(levels)
        self.levels = levels
        linked = np.where(self.tag == _TAG_AT["a"], 1, 0)
        for level in levels[1:]:
            linked[level] |= linked[self.parent[level]]
        total, in_links = words.astype(float), np.where(linked > 0, words, 0).astype(float)
        for level in reversed(levels[1:]):
            np.add.at(total, self.parent[level], total[level])
            np.add.at(in_links, self.parent[level], in_links[level])
        # Texts and inline elements say nothing by these; their blocks do.
        inline = _INLINE[self.tag]
        links = np.where(inline, 4, np.where(total == 0, 3, np.searchsorted(np.array([0.05, 0.6]), in_links / np.maximum(total, 1), "right")))
        self.look = self.tag * _LINK_VALUES + links
        self.length = np.where(inline, 6, _length_bucket(total))


@dataclass(frozen=True)
class TreeModel:
    """Log potentials: root, pair (relation, parent state, state), and one table per feature (value, state)."""

    root: np.ndarray
    pair: np.ndarray
    look: np.ndarray
    kind: np.ndarray
    length: np.ndarray

    def seen(self, f: Forest) -> np.ndarray:
        return self.look[f.look] + self.kind[f.kind] + self.length[f.length]

    def marginals(self, f: Forest) -> np.ndarray:
        """(nodes, states) probabilities, given everything seen of the node's page."""
        seen = self.seen(f)
        up, message = seen.copy(), np.zeros_like(seen)
        pair = np.exp(self.pair)
        for level in reversed(f.levels[1:]):
            top = up[level].max(axis=1, keepdims=True)
            message[level] = np.log(np.einsum("ns,nps->np", np.exp(up[level] - top), pair[f.relation[level]])) + top
            np.add.at(up, f.parent[level], message[level])
        down = np.zeros_like(seen)
        down[f.levels[0]] = self.root
        for level in f.levels[1:]:
            p = f.parent[level]
            rest = up[p] + down[p] - message[level]
            top = rest.max(axis=1, keepdims=True)
            down[level] = np.log(np.einsum("np,nps->ns", np.exp(rest - top), pair[f.relation[level]])) + top
        belief = up + down
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def _labelled(page: list) -> tuple[tuple[list[int], list[int], list[int], list[int]], list[int]]:
    parent, tag, kind, words, state = [-1], [_TAG_AT["#page"]], [0], [0], [2]

    def walk(node: Node, above: int) -> None:
        name, attrs, label, children = node
        parent.append(above), tag.append(_tag(name)), kind.append(_name_kind(attrs)), words.append(children[0] if name == "#text" else 0), state.append(label)
        if name == "#text":
            return
        me = len(parent) - 1
        for c in children:
            if isinstance(c, int):
                parent.append(me), tag.append(_TAG_AT["#text"]), kind.append(0), words.append(c), state.append(CONTENT if label == 2 else label)
            else:
                walk(c, me)

    for top in page:
        walk(top if not isinstance(top, int) else ("#text", "", CONTENT, [top]), 0)
    return (parent, tag, kind, words), state


def _tag(name: str | None) -> int:
    if name is None:
        return 0
    return _TAG_AT.get(name, _TAG_AT.get(_ALIKE.get(name, ""), _TAG_AT["other"]))


def fit(pages: list[list] | None = None) -> TreeModel:
    """Count conditional frequencies on labelled pages."""
    made = [_labelled(p) for p in (training_pages() if pages is None else pages)]
    f = Forest([m[0] for m in made])
    state = np.array([s for m in made for s in m[1]])

    def table(values: np.ndarray, size: int, silent: int | None = None) -> np.ndarray:
        count = np.full((size, STATES), _SMOOTH)
        np.add.at(count, (values, state), 1)
        if silent is not None:
            count[silent] = 0
        with np.errstate(divide="ignore"):
            out = np.log(count / count.sum(axis=0))
        if silent is not None:
            out[silent] = 0
        return out

    inner = f.parent >= 0
    pair = np.full((3, STATES, STATES), _SMOOTH)
    np.add.at(pair, (f.relation[inner], state[f.parent[inner]], state[inner]), 1)
    kind = table(f.kind, len(_NAMES))
    kind[-1] = np.log([1.0, 1e-6, 1e-6])  # hidden parts are never content
    root = np.log(np.array([1e-3, 1e-3, 1.0]))
    return TreeModel(root, np.log(pair / pair.sum(axis=2, keepdims=True)), table(f.look, len(_TAGS) * _LINK_VALUES), kind, table(f.length, 7, silent=6))


_model: list[TreeModel] = []


def default_model() -> TreeModel:
    if not _model:
        _model.append(fit())
    return _model[0]


_BLANK = re.compile(r"\s+")


def _nodes(page: Page, texts: list[str]) -> tuple[tuple[list[int], list[int], list[int], list[int]], list[int]]:
    """What ``Forest`` takes of a page, and the place of each node in it.

    An unnamed element that holds nothing but one unnamed element of its kind says no more
    than that one alone, so the two are one node; else a long chain of wrappers would
    outweigh everything that is seen inside it.
    """
    parent, tag, kind = page.parent, [_tag(n) for n in page.name], [_name_kind(a) for a in page.attrs]
    children = [0] * len(parent)
    for p in parent[1:]:
        children[p] += 1
    place, out = [], ([], [], [], [])
    for i, p in enumerate(parent):
        if p > 0 and children[p] == 1 and tag[i] == tag[p] > 0 and not kind[i] and not kind[p]:
            place.append(place[p])
            continue
        place.append(len(out[0]))
        out[0].append(place[p] if p >= 0 else -1), out[1].append(tag[i]), out[2].append(kind[i]), out[3].append(len(texts[i].split()))
    return out, place


def main_texts(documents: list[str], model: TreeModel) -> list[str]:
    pages = [Page(d) for d in documents]
    if not pages:
        return []
    texts = [[html.unescape(t) if t else t for t in p.text] for p in pages]
    nodes = [_nodes(p, ts) for p, ts in zip(pages, texts)]
    forest = Forest([n for n, _ in nodes])
    content = model.marginals(forest)[:, CONTENT] > 0.5
    out = []
    for page, ts, (_, place), first in zip(pages, texts, nodes, forest.first):
        blocks: list[str] = []
        block: list[str] = []
        for at in page.sequence:
            if at == BREAK:
                if block:
                    joined = _BLANK.sub(" ", "".join(block)).strip(" ")
                    if joined:
                        blocks.append(joined)
                    block = []
            elif at == SPACE:
                block.append(" ")
            elif content[first + place[at]]:
                block.append(ts[at])
            elif ts[at][:1].isspace() or ts[at][-1:].isspace():
                block.append(" ")
        out.append("\n".join(blocks))
    return out


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points).

    Blocks of the article, each with its white space (that of Unicode, so no-break spaces too)
    turned to single spaces and trimmed, are joined by one line feed; a <br> is white space. Null, empty and textless
    pages have empty text. Pages are judged one by one, so repeated ids and pages keep
    their rows. Other columns are ignored. Nothing is shuffled.
    """
    ship(pages.sparkSession)
    model = model or default_model()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 2_000_000):
            found = main_texts([h or "" for h in b.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
