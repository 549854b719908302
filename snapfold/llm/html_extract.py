"""Main text of web pages: boosted trees over DOM-node features and a decoding that keeps ancestors and descendants consistent.

Every block element of a page is a node. Trees score each node as main text or boilerplate; a dynamic programme
over the page's tree then picks for every node one of three states: mixed (its children choose), main, or
boilerplate. Below a main node only main and boilerplate may stand, below a boilerplate node only boilerplate.

The trees are trained on pages that this module makes itself (``training_pages``), a bounded number of them.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.llm import trees
from snapfold.llm.common import columns_of

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # text to the end tag, or to the page's end
SKIPPED = frozenset("noscript template svg".split())  # left out whole where an end tag follows
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary center hgroup nav header footer aside form fieldset legend "
    "button select option label textarea dialog menu head hr".split()
)
CLOSES_P = frozenset(
    "main article section div p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure figcaption address details center "
    "hgroup nav header footer aside form fieldset dialog menu hr".split()
)
#: An element that opens ends an open one of these kinds, unless one of the bounds stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "thead": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "body": (("head",), ()),
}
#: The same for an open p, which every element of CLOSES_P ends.
SCOPES = ENDS | {"p": (("p",), ("td", "th", "button", "table"))}
#: By tag: the scopes in which it is a kind or a bound.
MEMBER = {tag: [s for s, (kinds, bounds) in SCOPES.items() if tag in kinds or tag in bounds] for kinds, bounds in SCOPES.values() for tag in (*kinds, *bounds)}
#: Words of class, id and role that tell something about an element, by subject; a token counts if it starts with one of them.
#: Those in EXACT must be the whole token.
LEXICON = {
    "content": "article content post entry story body text prose main richtext markdown",
    "menu": "nav menu breadcrumb toc pagination pager tabs toolbar sitemap skip",
    "head": "header masthead topbar logo brand hero",
    "foot": "footer copyright legal colophon bottom imprint",
    "side": "sidebar aside rail related recommend widget trending popular more secondary complementary",
    "notice": "cookie notice consent gdpr alert popup modal overlay warning disclaimer privacy",
    "join": "subscribe newsletter signup paywall register promo cta",
    "advert": "advert sponsor banner dfp adsense adslot adbox adunit outbrain taboola",
    "comment": "comment disqus respond reply replies discussion reader feedback",
    "form": "form search login contact input",
    "share": "share social follow tweet facebook",
}
EXACT = {"ad": "advert", "ads": "advert", "adv": "advert"}
#: What a role says, whatever its letters begin with.
ROLES = {
    "contentinfo": "foot", "banner": "head", "navigation": "menu", "menubar": "menu", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice",
    "main": "content", "article": "content", "document": "content",
}
GROUPS = {t: i for i, t in enumerate(["article main", "nav menu", "header head", "footer", "aside", "form fieldset button select option label textarea legend dialog", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tfoot tr", "td th caption", "blockquote pre figure figcaption", "html body", "#text"])}
TAG_GROUP = {tag: i for names, i in GROUPS.items() for tag in names.split()}
OTHER_GROUP = len(GROUPS)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRS = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?]")
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bterms of (?:use|service)\b|\bprivacy policy\b", re.I)
_NUMBER = re.compile(r"&#(?=[0-9]{8})0*+([0-9]*)")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | SKIPPED}

MAIN, BOILERPLATE, MIXED = 1, 0, 2


def decoded(text: str) -> str:
    """Character references resolved. Numbers of any length are read; those beyond Unicode give U+FFFD."""
    if "&#" in text:
        text = _NUMBER.sub(lambda m: "&#1114112" if len(m[1]) > 7 else f"&#{m[1] or 0}", text)
    return entities.unescape(text)


def training_label(attrs: str) -> int:
    """What data-y says in a page of ``training_pages``; -1 where it is absent."""
    found = re.search(r'data-y="([01])"', attrs)
    return int(found[1]) if found else -1


@lru_cache(maxsize=50_000)
def token_mask(attrs: str) -> int:
    """Bit mask of the subjects that class, id and role name."""
    mask = 0
    for name, a, b, c in _ATTRS.findall(attrs):
        value = a or b or c
        name = name.lower()
        if name == "role":
            mask |= sum(1 << list(LEXICON).index(subject) for subject in {ROLES[r] for r in value.lower().split() if r in ROLES})
        elif name in ("class", "id", "itemprop", "aria-label", "data-component"):
            for token in _TOKEN.findall(value):
                token = token.lower()
                if token in EXACT:
                    mask |= 1 << list(LEXICON).index(EXACT[token])
                for i, stems in enumerate(LEXICON.values()):
                    if any(token.startswith(s) for s in stems.split()):
                        mask |= 1 << i
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            mask |= 1 << len(LEXICON)
    return mask


class Page:
    """Block elements of a page in page order, and its runs of text."""

    __slots__ = ("chars", "depth", "group", "label", "last", "legal", "links", "marks", "mask", "parent", "pieces", "words")

    def __init__(self, source: str, training: bool = False):
        self.parent, self.depth, self.group, self.mask, self.label = [-1], [0], [TAG_GROUP["html"]], [0], [-1]
        self.chars, self.links, self.marks, self.words, self.legal, self.last = [0], [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, decoded text of one block)
        self._scan(source, training)
        end = list(range(1, len(self.parent) + 1))  # one past the last descendant
        for i in range(len(end) - 1, 0, -1):
            if end[self.parent[i]] < end[i]:
                end[self.parent[i]] = end[i]
        self.last = end

    def _node(self, parent: int, tag: str, mask: int, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.group.append(TAG_GROUP.get(tag, OTHER_GROUP))
        self.mask.append(mask)
        self.label.append(label)
        for column in (self.chars, self.links, self.marks, self.words, self.legal):
            column.append(0)
        return len(self.parent) - 1

    def _scan(self, source: str, training: bool) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, its node or its block's node)
        run: list[str] = []
        linked = 0
        filled: set[int] = {0}  # nodes that hold other blocks: a run of text in them is a node of its own
        missing: dict[str, bool] = {}  # skipped elements without an end tag
        count: dict[str, int] = {}  # open elements by tag
        places: dict[str, list[int]] = {s: [] for s in SCOPES}  # of the open kinds and bounds of each scope, in the stack

        def cut_to(k: int) -> None:
            while len(stack) > k:
                tag = stack.pop()[0]
                count[tag] -= 1
                for s in MEMBER.get(tag, ()):
                    places[s].pop()

        def end_open(scope: str) -> None:
            kinds, at = SCOPES[scope][0], places[scope]
            while at and stack[at[-1]][0] in kinds:
                cut_to(at[-1])

        def close() -> None:
            nonlocal linked
            if run:
                text = " ".join(decoded("".join(run)).split())
                if text:
                    node = stack[-1][1]
                    if node in filled:
                        node = self._node(node, "#text", 0, self.label[node])
                    self.chars[node] += len(text)
                    self.links[node] += min(linked, len(text))
                    self.marks[node] += len(_MARKS.findall(text))
                    self.words[node] += text.count(" ") + 1
                    self.legal[node] += len(_LEGAL.findall(text))
                    self.pieces.append((node, text))
                run.clear()
            linked = 0

        pos, size, links = 0, len(source), 0
        while pos < size:
            at = source.find("<", pos)
            if at < 0:
                run.append(source[pos:])
                break
            if at > pos:
                run.append(source[pos:at])
                if links:
                    linked += at - pos
            if source.startswith("<!--", at):
                pos = source.find("-->", at + 4)
                if pos < 0:
                    break
                pos += 3
                continue
            after = source[at + 1 : at + 2]
            if after in ("!", "?"):
                pos = source.find(">", at)
                if pos < 0:
                    break
                pos += 1
                continue
            if not (after == "/" or after.isascii() and after.isalpha()):
                run.append("<")
                if links:
                    linked += 1
                pos = at + 1
                continue
            if source.find(">", at) < 0:
                break  # a tag that the page's end cuts off
            found = _TAG.match(source, at)
            if found:
                closing, tag, attrs = found[1], found[2].lower(), found[3]
                pos = found.end()
            else:
                end = source.find(">", at)
                head = re.match(r"(/?)([a-zA-Z][^\s/>]*|)", source[at + 1 : min(end, at + 64)])
                closing, tag, attrs, pos = head[1], head[2].lower(), "", end + 1
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag == "br":
                    run.append(" ")
                elif count.get(tag):
                    close()
                    while stack[-1][0] != tag:
                        cut_to(len(stack) - 1)
                    cut_to(len(stack) - 1)
                    links = 0
                continue
            if tag in RAW or tag in SKIPPED:
                if attrs.endswith("/") and tag == "svg":
                    continue
                end = missing.get(tag) is None and _END[tag].search(source, pos) or None
                if end is None:
                    if tag in RAW:
                        break
                    missing[tag] = True  # no later one is closed either
                    continue
                pos = source.find(">", end.end())
                if pos < 0:
                    break
                pos += 1
                continue
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links += 1
            elif tag in BLOCK and tag != "html":
                close()
                if tag in CLOSES_P:
                    end_open("p")
                if tag in ENDS:
                    end_open(tag)
                links = 0
                parent = stack[-1][1]
                filled.add(parent)
                if tag != "hr":
                    label = training_label(attrs) if training else -1
                    stack.append((tag, self._node(parent, tag, token_mask(attrs) if attrs else 0, label if label >= 0 else self.label[parent])))
                    count[tag] = count.get(tag, 0) + 1
                    for s in MEMBER.get(tag, ()):
                        places[s].append(len(stack) - 1)
        close()


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from 0."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1))) if len(depth) else []


def features(pages: list[Page]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Feature rows of all nodes of some pages, one page after the other, and the tree's columns."""
    sizes = np.array([len(p.parent) for p in pages])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    join = lambda name: np.array([x for p in pages for x in getattr(p, name)], dtype=np.int64)
    parent, last, depth, group, mask = join("parent"), join("last"), join("depth"), join("group"), join("mask")
    parent = np.where(parent >= 0, parent + start, -1)
    last = last + start
    n = len(parent)
    up = np.where(parent >= 0, parent, np.arange(n))
    total = {}
    for name in ("chars", "links", "marks", "words", "legal"):
        sums = np.concatenate([[0], np.cumsum(join(name))])
        total[name] = (sums[last] - sums[np.arange(n)]).astype(float)
        total[f"before_{name}"] = (sums[:-1] - sums[start]).astype(float)
    nodes = (last - np.arange(n)).astype(float)
    page_chars = total["chars"][start]
    behind = page_chars - total["before_chars"] - total["chars"]
    siblings = np.bincount(up, minlength=n)[up].astype(float)
    key = up * (OTHER_GROUP + 1) + group
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    same = counts[inverse].astype(float)
    order = np.arange(n)
    first_child = np.full(n, n)
    np.minimum.at(first_child, up[parent >= 0], order[parent >= 0])
    level_rank = order - first_child[up]
    mean_sibling = np.bincount(up, total["chars"], n)[up] / np.maximum(siblings, 1)
    paragraphs = np.bincount(up, (group == TAG_GROUP["p"]) * 1.0, n)
    # What ancestors say, and how near the page's main element is.
    around = mask.copy()
    in_article = (group == TAG_GROUP["article"]) * 1
    in_boiler = np.isin(group, [TAG_GROUP[t] for t in ("nav", "header", "footer", "aside", "form")]) * 1
    levels = _levels(depth)
    for rows in levels[1:]:
        around[rows] |= around[up[rows]]
        in_article[rows] |= in_article[up[rows]]
        in_boiler[rows] |= in_boiler[up[rows]]
    bits = np.arange(len(LEXICON) + 1)
    X = np.column_stack([
        depth, np.log1p(total["chars"]), total["links"] / np.maximum(total["chars"], 1), np.log1p(nodes), np.log1p(total["chars"] / nodes),
        total["marks"] / np.maximum(total["words"], 1), total["words"] / nodes, np.log1p(paragraphs), np.log1p(siblings), same / np.maximum(siblings, 1),
        np.log1p(np.maximum(level_rank, 0)), np.log1p(mean_sibling), total["chars"] / np.maximum(total["chars"][up], 1), total["before_chars"] / np.maximum(page_chars, 1),
        total["chars"] / np.maximum(page_chars, 1), behind / np.maximum(page_chars, 1), behind == 0, total["legal"] / np.maximum(total["words"], 1), total["legal"] > 0, in_article, in_boiler, total["links"][up] / np.maximum(total["chars"][up], 1),
        group[:, None] == np.arange(OTHER_GROUP + 1), (mask[:, None] >> bits) & 1, (around[:, None] >> bits) & 1,
    ]).astype(np.float32)
    return X, {"parent": up, "levels": levels, "start": start, "chars": total["chars"], "label": join("label"), "sizes": sizes}


def decode(score: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The state of every node that makes the sum of scores largest and no ancestor contradict a descendant."""
    up, levels, n = tree["parent"], tree["levels"], len(score)
    own = np.clip(score, -4, 4) * (1 + np.log1p(tree["chars"]))
    best = np.zeros((3, n))  # by state: the most that the node's subtree can give
    best[MAIN], best[BOILERPLATE] = own, -own
    for rows in levels[:0:-1]:
        to = up[rows]
        np.add.at(best[BOILERPLATE], to, best[BOILERPLATE, rows])
        np.add.at(best[MAIN], to, np.maximum(best[MAIN, rows], best[BOILERPLATE, rows]))
        np.add.at(best[MIXED], to, best[:, rows].max(0))
    state = np.empty(n, dtype=np.int8)
    for d, rows in enumerate(levels):
        free = best[:, rows].argmax(0)
        under_main = np.where(best[MAIN, rows] >= best[BOILERPLATE, rows], MAIN, BOILERPLATE)
        above = state[up[rows]] if d else np.full(len(rows), MIXED)
        state[rows] = np.where(above == BOILERPLATE, BOILERPLATE, np.where(above == MAIN, under_main, free))
    return state


def extract_pages(sources: list[str], model) -> list[str]:
    out: list[str] = []
    for i in range(0, len(sources), 256):
        pages = [Page(s) for s in sources[i : i + 256]]
        X, tree = features(pages)
        state = decode(trees.log_odds(model, X), tree)
        offset = 0
        for page in pages:
            out.append("\n".join(text for node, text in page.pieces if state[offset + node] == MAIN))
            offset += len(page.parent)
    return out


def training_pages(n: int = 400, seed: int = 7) -> Iterator[str]:
    """Made-up pages of many layouts whose elements carry data-y: 1 in the article, 0 in boilerplate, none where both meet."""
    rng = random.Random(seed)
    syllables = "an be ci do er fa ge hu in jo ka le mo nu or pe qua ri st tu ve wo za ção über été".split()

    def words(low, high):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", ","]) for _ in range(rng.randint(low, high)))

    def sentence(low=1, high=18):
        return words(low, high).capitalize() + rng.choice(".....!?")

    def prose(low=1, high=9):
        text = " ".join(sentence() for _ in range(rng.randint(low, high)))
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(1, 4)}</a> ' + sentence()
        if rng.random() < 0.15:
            text = "<b>" + text + rng.choice(["</b>", "", "<br>"])
        return text

    def named(subject, tags="div div section"):
        token = rng.choice(LEXICON[subject].split())
        attr = rng.choice(["class", "class", "id"])
        token = rng.choice([token, f"{token}-box", f"site-{token}", f"{token}s", f"{token} wide"])
        return rng.choice(tags.split()), f' {attr}="{token}"'

    def wrap(tag, attrs, inner, label):
        return f"<{tag}{attrs}" + (f' data-y="{label}"' if label is not None else "") + f">{inner}</{tag}>"

    def links(k):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def legal():
        mark = rng.choice(["&copy;", "Copyright", "Copyright &copy;", "(c)"])
        return f"{mark} {rng.randint(1990, 2030)} {words(1, 3)}. " + rng.choice(["All rights reserved.", "", "Privacy policy", f'<a href="/t">Terms of use</a> | <a href="/p">{words(1, 2)}</a>'])

    def bare(kind):
        """Boilerplate that no name gives away: its role, its place, its links or its words do."""
        if kind == "foot":
            inner = rng.choice([legal(), f"<p>{legal()}</p>", f"<div>{legal()}</div>", f"{words(1, 2)} | {legal()}"])
        elif kind == "head":
            inner = rng.choice([words(1, 3), f'<a href="/">{words(1, 3)}</a>'])
        else:
            inner = rng.choice([links(rng.randint(2, 8)), " | ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rng.randint(2, 7)))])
        role = {"foot": "contentinfo", "head": "banner", "menu": "navigation", "side": "complementary"}[kind]
        if rng.random() < 0.5:
            return wrap("div", f' role="{role}"', rng.choice([inner, words(1, 3), f"<p>{sentence()}</p>"]), 0)
        return wrap(rng.choice(["div", "div", "p"]) if "<p>" not in inner and "<div>" not in inner and "<ul>" not in inner else "div", "", inner, 0)

    def boiler(kind):
        if kind in ("foot", "menu", "side", "head") and rng.random() < 0.3:
            return bare(kind)
        if kind == "menu":
            tag, attrs = rng.choice([("nav", ""), ("nav", ' class="menu"'), named("menu")])
            return wrap(tag, attrs, links(rng.randint(2, 9)), 0)
        if kind == "head":
            tag, attrs = rng.choice([("header", ""), ("header", ""), named("head")])
            return wrap(tag, attrs, rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 5)}</p>"]) + (links(3) if rng.random() < 0.4 else ""), 0)
        if kind == "foot":
            tag, attrs = rng.choice([("footer", ""), ("footer", ""), named("foot")])
            return wrap(tag, attrs, rng.choice(["&copy; ", "", "<p>"]) + rng.choice([sentence(), prose(1, 4), legal()]) + (links(3) if rng.random() < 0.3 else ""), 0)
        if kind == "side":
            tag, attrs = rng.choice([("aside", ""), ("aside", ' class="sidebar"'), named("side")])
            return wrap(tag, attrs, f"<h3>{words(1, 4)}</h3>" + rng.choice([links(rng.randint(2, 6)), f"<p>{prose(1, 4)}</p>"]), 0)
        if kind == "form":
            return wrap("form", rng.choice(["", ' class="search"', ' id="login"']), f"<label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{sentence()}</p>"]), 0)
        if kind == "advert" and rng.random() < 0.5:
            return wrap(rng.choice(["div", "section"]), f' class="{rng.choice(["ad", "ads", "ad-slot", "ad top"])}"', rng.choice([sentence(), prose(1, 4)]), 0)
        if kind == "comment":
            tag, attrs = named("comment", "div section ul ol")
            item = "li" if tag in ("ul", "ol") else rng.choice(["div", "p", "article"])
            inner = "".join(wrap(item, rng.choice(["", ' class="comment"']), rng.choice([prose(1, 5), f"<p>{prose(1, 5)}</p>", f"<b>{words(1, 2)}</b> {prose(1, 3)}"]), None) for _ in range(rng.randint(1, 6)))
            return wrap(tag, attrs, (f"<h2>{words(1, 3)}</h2>" if rng.random() < 0.5 and item != "li" else "") + inner, 0)
        tag, attrs = named(kind)
        return wrap(tag, attrs, rng.choice([sentence(), prose(1, 4), f"<p>{prose(1, 3)}</p>", links(3)]), 0)

    def article():
        body = []
        if rng.random() < 0.85:
            title = f"<h1>{words(1, 12)}</h1>"
            if rng.random() < 0.25:
                title = "<header>" + title + rng.choice(["", f"<p>{words(1, 6)}</p>", f"<p>{sentence()}</p>", f"<div>{words(2, 5)}</div>"]) + "</header>"
            body.append(title)
        close = "</p>" if rng.random() < 0.7 else ""
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                body.append(f"<p>{prose()}{close}" if rng.random() < 0.9 else f"<p>{words(1, 2).capitalize()}.</p>")
            elif r < 0.8:
                body.append(f"<h{(k := rng.randint(2, 4))}>{words(1, 8)}</h{k}>")
            elif r < 0.86:
                body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.9:
                body.append(f"<blockquote>{prose(1, 3)}</blockquote>")
            elif r < 0.93:
                body.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.96:
                body.append(f"<pre>{words(3, 20)}</pre>")
            else:
                body.append(f"<div>{prose(1, 4)}</div>")
        for kind in ("advert", "share", "join", "side", "notice", "comment", "form"):
            if rng.random() < 0.09:
                body.insert(rng.randint(0, len(body)), boiler(kind))
        if rng.random() < 0.12:  # straight in the page's body
            return "".join(re.sub(r"^<([a-z0-9]+)>", r'<\1 data-y="1">', part) for part in body)
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("div", ' role="main"'), ("div", ' role="article"'), ("main", ""), ("main", ' id="content"'), named("content"), named("content"), ("div", ""), ("section", "")])
        inner = "".join(body)
        if rng.random() < 0.15:
            inner = f"<div>{inner}</div>"
        return wrap(tag, attrs, inner, 1)

    for i in range(n):
        if i % 25 == 0:  # nothing but text
            yield f'<html><body data-y="1">{rng.choice([prose(1, 6), f"<pre>{prose(1, 4)}</pre>", "".join(f"<p>{prose(1, 3)}</p>" for _ in range(rng.randint(1, 5)))])}</body></html>'
            continue
        before = [boiler(k) for k in ("head", "menu", "notice", "advert", "form", "side", "join") if rng.random() < 0.4]
        after = [boiler(k) for k in ("side", "share", "comment", "advert", "join", "form", "notice", "foot", "menu") if rng.random() < 0.4]
        rng.shuffle(before)
        main = article()
        if rng.random() < 0.25:
            extra = [boiler(k) for k in ("side", "comment", "advert") if rng.random() < 0.5]
            main = wrap(rng.choice(["div", "main", "section"]), rng.choice(["", ' class="container"', ' class="layout"']), main + "".join(extra), None)
        page = "".join(before) + main + "".join(after)
        if rng.random() < 0.2:
            page = f'<div class="wrapper">{page}</div>'
        yield f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>"


@lru_cache(maxsize=2)
def train(n_pages: int = 400, seed: int = 7):
    """Boosted trees from ``n_pages`` made-up pages, the documented bound of the training sample."""
    X, tree = features([Page(s, training=True) for s in training_pages(n_pages, seed)])
    known = tree["label"] >= 0
    weight = 1 + np.log1p(tree["chars"][known]) / 4
    return trees.boost(X[known], tree["label"][known], weight, trees=60, depth=5, rate=0.25)


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text", model=None) -> DataFrame:
    """Add column ``text``, the main text of each row's whole html, and ``n_chars``, its code points.

    Null, empty and text-free pages give ''. White space is Unicode's: a no-break space inside a block folds as well.
    Rows are independent: repeated rows give repeated results, an empty table an empty one. Other columns pass through
    as they are, of whatever type; those named like the results are replaced.
    """
    model = model or train()
    replaced = (text.lower(), "n_chars", html.lower())
    rest = [c for c, name in zip(columns_of(pages), pages.columns, strict=True) if name.lower() not in replaced]
    schema = T.StructType([*pages.select(*rest).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = extract_pages([s or "" for s in batch.column(batch.num_columns - 1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[f.name for f in schema])

    return pages.select(*rest, F.col(html)).mapInArrow(run, schema).withColumn("n_chars", F.length(text).cast("long"))
