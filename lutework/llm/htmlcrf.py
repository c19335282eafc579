"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between tags of block level, in page order, with the path of their ancestors. Each block
has binary features of its ancestors' tags, of their class and id words and of its text; the chain labels every block main text or
other, and Viterbi decoding picks the labels. The field is trained by gradient steps on its exact log-likelihood (forward-backward)
over TRAINING_PAGES labelled pages, which labelled_pages() writes from a seed in many layouts. Scripts, styles and markup are no
text and never make blocks.

Defined results: null and empty html give an empty text; broken markup is read as browsers do where it matters here (unclosed and stray tags, quotes within unquoted
values and names, tags that the page ends in, character references without semicolon, comments with any of their ends, declarations); a page of any depth costs its length; repeated rows are pages of their own; an empty table
gives an empty result; other columns are ignored.
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

from .common import in_small_batches

TRAINING_PAGES, EPOCHS, RATE, PENALTY, SEED = 700, 10, 0.5, 1e-4, 11
FEATURES = 1 << 12

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select option textarea".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: What stands in a text without parting it.
SILENT = frozenset("script style noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: A tag whose start ends an open one of the same kind.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: What may stand in a head; any other tag, and text, ends one that is open. A select ends where a block begins, drawings and formulas where the tags begin
#: that browsers let out of them, and what stands in for an object or canvas with the next part of the page.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
OPTIONS = frozenset("select option optgroup".split())
FOREIGN = frozenset("svg math".split())
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var article section main footer header nav aside form".split()
)
STANDINS = frozenset("object canvas".split())
PARTS = frozenset("article section main footer header nav aside body h1".split())
SCOPED = frozenset("p li b i a span td tr".split())
KNOWN = LEAVES | frozenset(
    "address figure figcaption fieldset form form details summary dialog label legend button tr td th tbody thead tfoot caption colgroup hgroup html q hr select option textarea iframe "
    "object canvas svg math search center dir frameset noscript template title script style".split()
)
BARRIER = frozenset("table ul ol dl div article section aside nav header footer main form body html blockquote".split())
#: Markup begins with one of these; attributes are read one by one, a quote being one only where a value begins, as browsers do.
MARKUP = re.compile(r"<(?:(?P<comment>!--)|(?P<bogus>[!?]|/(?![a-zA-Z]))|(?P<end>/)?(?P<name>[a-zA-Z][^\t\n\f\r />]*))")
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
ATTRIBUTE = re.compile(r"[\t\n\f\r /]*+(?:(?P<close>>)|(?P<key>[^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"(?P<a>[^\"]*+)(?P<a_end>\"|$)|'(?P<b>[^']*+)(?P<b_end>'|$)|(?P<c>[^\t\n\f\r >]*+)))?)")
WORDS = re.compile(r"[a-z]+")
BLANKS = re.compile(r"\s+")


class Node:
    """An open element: its tag, and what its content inherits: the names of its features, the number of elements around it and of the nearest barrier."""

    __slots__ = ("tag", "names", "depth", "barrier", "last")

    def __init__(self, tag: str, above: "Node | None", marks: set[str], at: int):
        self.tag = tag
        block = tag not in INLINE
        own = {f"in:{tag if tag in KNOWN else 'other'}"} if block else set()
        if tag not in ("html", "body"):  # what these are called says nothing of a part
            own |= {f"cue:{c}" for w in marks if (c := CUE_OF.get(w))} | ({"hidden"} if "hidden" in marks else set())
        own |= {"inside"} if tag in ("article", "main") else set()
        around = above.names if above else frozenset()
        self.names = around if own <= around else around | own  # shared all the way down where nothing is new
        self.depth = (above.depth if above else 0) + block
        self.barrier = at if tag in BARRIER else above.barrier if above else -1
        self.last = (tag if tag in KNOWN else "other") if block else above.last if above else ""


class Block:
    """A leaf block: its text, white space made one blank; the innermost element around it; words inside links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _attributes(page: str, at: int) -> tuple[int, set[str], bool]:
    """From behind a tag's name: where the tag ends (-1 if it doesn't), the words that its attributes mark it with, and whether it closes itself."""
    marks: set[str] = set()
    while (m := ATTRIBUTE.match(page, at)) is not None:
        at = m.end()
        if m["close"]:
            return at, marks, page[at - 2] == "/"
        key, value = m["key"].lower(), m["a"] or m["b"] or m["c"] or ""
        if m["a_end"] == "" or m["b_end"] == "":
            return -1, marks, False
        if key in ("class", "id", "role", "itemprop"):
            marks.update(WORDS.findall(value.lower()))
        elif key == "hidden" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            marks.add("hidden")
    return -1, marks, False


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that show text, in order. Every step costs what it reads or closes, however deep elements are nested."""
    page = page or ""
    found: list[Block] = []
    stack: list[Node] = []
    open_at: dict[str, list[int]] = {}  # by tag, the places of open elements in the stack
    parts: list[str] = []
    linked = hidden = 0

    def cut(k: int) -> None:
        """Closes the k-th open element with all in it."""
        nonlocal hidden
        while len(stack) > k:
            tag = stack.pop().tag
            open_at[tag].pop()
            hidden -= tag in HIDDEN

    def close() -> None:
        nonlocal linked
        if parts:
            text = BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def is_open(tags: frozenset[str]) -> bool:
        return any(open_at.get(t) for t in tags)

    def leave(tags: frozenset[str]) -> None:
        """Closes the outermost open one of tags, with all in it."""
        cut(min(open_at[t][0] for t in tags if open_at.get(t)))

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1].tag == "head" and not text.isspace():
            cut(len(stack) - 1)
        if text and not hidden:
            plain = entities.unescape(text)
            parts.append(plain)
            if open_at.get("a"):
                linked += len(plain.split())

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["comment"] or m["bogus"]:
            end = (COMMENT_END if m["comment"] else re.compile(">")).search(page, at if m["comment"] else at - 1)
            at = end.end() if end else n
            continue
        name = m["name"].lower()
        at, marks, closed = _attributes(page, at)
        if at < 0:
            break  # a tag that the page ends in
        if m["end"]:
            places = open_at.get(name)
            if places and not (name in SCOPED and stack[-1].barrier > places[-1]):
                if name not in INLINE and name not in SILENT:
                    close()
                cut(places[-1])
            elif name in ("p", "br"):
                close()
            continue
        if hidden:
            if open_at.get("head") and name not in HEAD and not open_at.get("template"):
                leave(frozenset(["head"]))
            if is_open(OPTIONS) and (name not in OPTIONS and name not in INLINE and name != "hr" or open_at.get("select") and name in ("input", "select", "textarea")):
                leave(OPTIONS)
            if is_open(FOREIGN) and name in LEAVES and not open_at.get("foreignobject"):
                leave(FOREIGN)
            if is_open(STANDINS) and name in PARTS:
                leave(STANDINS)
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                parts.append(" " if parts and name == "br" else "")
                continue
        elif name not in SILENT:
            close()
            ends = [open_at[t][-1] for t in CLOSES.get(name, ()) if open_at.get(t)]
            if ends and max(ends) > stack[-1].barrier:
                cut(max(ends))
        if name in VOID or closed and (is_open(FOREIGN) or name not in KNOWN and name not in INLINE):
            continue
        open_at.setdefault(name, []).append(len(stack))
        stack.append(Node(name, stack[-1] if stack else None, marks, len(stack)))
        hidden += name in HIDDEN
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\t\n\f\r />]|$)", re.I).search(page, at)
            at = end.start() if end else n
    close()
    return found


# Features

CUES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pager pagination",
    "ad": "ad ads advert advertisement adv banner sponsor sponsored promo promotion",
    "side": "sidebar side aside widget rail related recommended trending popular",
    "foot": "footer foot copyright legal bottom",
    "head": "header head masthead top logo",
    "talk": "comment comments reply replies disqus discussion respond reader",
    "note": "cookie cookies notice consent gdpr alert popup modal newsletter subscribe paywall banner warning",
    "form": "form search login signup register",
    "share": "share social follow",
    "main": "article content main post entry story body text page",
}
CUE_OF = {w: cue for cue, words in CUES.items() for w in words.split()}
SET_TEXT = re.compile(
    r"©|\(c\)|copyright|all rights reserved|cookies?|privacy|subscribe|newsletter|sign (?:in|up)|log ?in|advertis|sponsored|share (?:this|on)|follow us|related|comments?\b|repl(?:y|ied)|click here|terms",
    re.I,
)


def _bucket(name: str) -> int:
    """A fixed place for a feature's name."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % FEATURES


#: Tags and cues of what isn't the main text.
ASIDE = frozenset(["in:nav", "in:aside", "in:footer", "in:form", "in:header", "in:button", "in:dialog", "hidden", *(f"cue:{c}" for c in ("nav", "ad", "side", "foot", "head", "talk", "note", "form", "share"))])


@lru_cache(maxsize=100_000)
def _context(names: frozenset[str], depth: int, last: str) -> tuple[int, ...]:
    own = names | {f"last:{last}", f"depth:{min(8, depth)}"}
    if not names & ASIDE:
        own |= {"plain"}
    return tuple(_bucket(x) for x in sorted(own))


def featured(found: list[Block]) -> list[list[int]]:
    """The features of each block of a page."""
    out = []
    longest = max((len(b.text) for b in found), default=1)
    inside = any(b.node is not None and "inside" in b.node.names for b in found)
    for b in found:
        n = len(b.text.split())
        names, depth, last = (b.node.names, b.node.depth, b.node.last) if b.node else (frozenset(), 0, "")
        plain = not names & ASIDE
        links = round(4 * min(1.0, b.linked / max(1, n)))
        own = [f"n:{min(7, n.bit_length())}", f"links:{links}", f"stop:{b.text[-1] in '.!?…。:\"”'}", f"share:{round(4 * len(b.text) / longest)}"]
        if plain:
            own += ["plain:links" if links > 2 else "plain:text", f"plain:n:{min(7, n.bit_length())}", f"plain:{inside}:{'inside' in names}"]
        if m := SET_TEXT.search(b.text):
            own += ["set", f"set:{min(7, n.bit_length())}", f"set:{m.start() == 0}", f"set:plain:{plain}:{'inside' in names}"]
        if "|" in b.text or "»" in b.text or "·" in b.text:
            own.append("bars")
        out.append([*_context(names, depth, last), *(_bucket(x) for x in own)])
    return out


# The field: weights[label, feature], moves[label before, label]


def _emissions(weights: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    return np.array([weights[:, f].sum(axis=1) for f in feats])


def viterbi(weights: np.ndarray, moves: np.ndarray, feats: list[list[int]]) -> list[int]:
    """The likeliest labels: 1 for main text."""
    if not feats:
        return []
    e = _emissions(weights, feats)
    best, back = e[0], []
    for x in e[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + x
    labels = [int(best.argmax())]
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    return labels[::-1]


def _expected(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and, summed, of pairs of neighbours."""
    n = len(e)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = e[0]
    for t in range(1, n):
        forward[t] = e[t] + np.logaddexp(forward[t - 1, 0] + moves[0], forward[t - 1, 1] + moves[1])
    for t in range(n - 2, -1, -1):
        x = e[t + 1] + backward[t + 1]
        backward[t] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
    z = np.logaddexp(*forward[-1])
    one = np.exp(forward + backward - z)
    if n == 1:
        return one, np.zeros((2, 2))
    two = np.exp(forward[:-1, :, None] + moves + (e[1:] + backward[1:])[:, None, :] - z).sum(axis=0)
    return one, two


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights by adaptive gradient ascent on the penalised log-likelihood of labelled pages (features, labels)."""
    weights, moves = np.zeros((2, FEATURES)), np.zeros((2, 2))
    seen_w, seen_m = np.full((2, FEATURES), 1e-6), np.full((2, 2), 1e-6)
    order = random.Random(SEED)
    pages = [p for p in pages if p[0]]
    for _ in range(epochs):
        order.shuffle(pages)
        for start in range(0, len(pages), 20):
            grad_w, grad_m = -PENALTY * weights, -PENALTY * moves
            for feats, labels in pages[start : start + 20]:
                one, two = _expected(_emissions(weights, feats), moves)
                for f, p, y in zip(feats, one, labels, strict=True):
                    diff = -p
                    diff[y] += 1
                    for label in (0, 1):
                        np.add.at(grad_w[label], f, diff[label])
                for a, b in zip(labels, labels[1:], strict=False):
                    grad_m[a, b] += 1
                grad_m -= two
            seen_w += grad_w**2
            seen_m += grad_m**2
            weights += rate * grad_w / np.sqrt(seen_w)
            moves += rate * grad_m / np.sqrt(seen_m)
    return weights, moves


# Labelled pages to train on


SAID = (
    "Subscribe to our newsletter was the title of", "The cookies were baked and", "Sign in to the church, said", "They replied that", "The terms of the peace were", "Her comment on the copyright of", "Privacy is what",
    "Related to this is", "An advertisement in the paper of", "Share this with", "Follow us, they said, and",
)


def _prose(r: random.Random, n: int) -> str:
    syllables = "an be ca do er fi go ha in ka lo ment ne on pa que re sch ti un ver wo é ü ñ th".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]
    words[0] = words[0].capitalize()
    return " ".join(words)


def _sentence(r: random.Random, low: int = 4, high: int = 60) -> str:
    return _prose(r, r.randint(low, high)) + r.choice([".", ".", ".", "!", "?", ""])


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page in a layout drawn from r, and the label of each of its leaf blocks."""
    labels: list[int] = []

    def text(label: int, s: str) -> str:
        labels.append(label)
        return s

    def attrs(*names: str) -> str:
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f" class='x-{name} col'", f' class="{name}-wrap"'])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{text(0, _prose(r, r.randint(1, 3)))}</a></li>' for i in range(n))

    def menu() -> str:
        tag = r.choice(["nav", "nav", "div", "ul"])
        if tag == "ul":
            return f"<ul{attrs('menu', 'nav', 'navbar')}>{links(r.randint(2, 8))}</ul>"
        return f"<{tag}{attrs('menu', 'nav', 'navbar', 'breadcrumbs') if tag == 'nav' else ' class=menu'}><ul>{links(r.randint(2, 8))}</ul></{tag}>"

    def header() -> str:
        tag = r.choice(["header", "header", "div"])
        name = attrs("header", "masthead", "top") if tag == "header" else ' class="header"'
        return f"<{tag}{name}>{'<h1>' + text(0, _prose(r, 3)) + '</h1>' if r.random() < 0.5 else '<p>' + text(0, _sentence(r, 2, 8)) + '</p>'}</{tag}>"

    def side() -> str:
        tag = r.choice(["aside", "aside", "div"])
        name = attrs("sidebar", "related", "widget") if tag == "aside" else r.choice([' class="sidebar"', ' class="related"', ' id="sidebar"'])
        inner = f"<h3>{text(0, _prose(r, 2))}</h3>" + (f"<ul>{links(r.randint(1, 5))}</ul>" if r.random() < 0.6 else f"<p>{text(0, _sentence(r))}</p>")
        return f"<{tag}{name}>{inner}</{tag}>"

    def advert() -> str:
        name = r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo"])
        inner = text(0, _sentence(r, 3, 40))
        return r.choice([f'<div class="{name}">{inner}</div>', f'<div class="{name}"><p>{inner}</p></div>', f'<section id="{name}"><a href="/x">{inner}</a></section>'])

    def notice() -> str:
        name = r.choice(["cookie", "notice", "consent", "newsletter", "popup", "alert"])
        s = r.choice(["We use cookies. ", "Subscribe to our newsletter. ", "Please accept our privacy terms. ", ""]) + _sentence(r, 3, 25)
        return f'<div class="{name}"><p>{text(0, s)}</p></div>'

    def form() -> str:
        return f'<form action="/s"><label>{text(0, _prose(r, 2))}</label><div><button>{text(0, _prose(r, 1))}</button></div></form>' if r.random() < 0.5 else f"<form><p>{text(0, _sentence(r, 2, 12))}</p><input type=text></form>"

    def comments() -> str:
        name = r.choice(["comments", "comment-list", "replies", "discussion"])
        inner = "".join(f'<div class="comment"><p>{text(0, _sentence(r, 3, 60))}</p></div>' for _ in range(r.randint(1, 4)))
        return f'<{r.choice(["section", "div"])} id="{name}">{inner}</section></div>' if r.random() < 0.1 else f'<section id="{name}">{inner}</section>'

    def footer() -> str:
        tag = r.choice(["footer", "footer", "footer", "div"])
        name = attrs("footer", "legal") if tag == "footer" else ' class="footer"'
        s = r.choice(["&copy; example.org &middot; ", "Copyright 2020. ", "All rights reserved. ", ""]) + _sentence(r, 2, 20)
        inner = text(0, s)
        return f"<{tag}{name}>{inner if r.random() < 0.6 else '<p>' + inner + '</p>'}</{tag}>"

    def article() -> str:
        out = []
        if r.random() < 0.8:
            out.append(f"<h1>{text(1, _prose(r, r.randint(1, 12)))}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 40])):
            kind = r.random()
            s = _sentence(r, 1, r.choice([3, 20, 150]))
            if r.random() < 0.12:  # what parts around a text say, said by the text
                s = r.choice(SAID) + " " + _sentence(r, 3, 30)
            if kind < 0.5:
                out.append(f"<p>{text(1, s)}</p>")
            elif kind < 0.6:
                out.append(f"<p><b>{text(1, s)}<br>")
            elif kind < 0.68:
                out.append(f"<p>{text(1, s + ' <a href=/y>' + _prose(r, 3) + '</a> ' + _sentence(r))}")
            elif kind < 0.75:
                out.append(f"<h2>{text(1, _prose(r, 3))}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{text(1, _sentence(r, 2, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{text(1, s)}</p></blockquote>")
            elif kind < 0.9:
                out.append(f"<pre>{text(1, s)}</pre>")
            elif kind < 0.93:
                out.append(f"<table><tr><td>{text(1, _sentence(r, 1, 4))}</td><td>{text(1, _sentence(r, 1, 4))}</td></tr></table>")
            elif kind < 0.96:
                out.append(advert())
            else:
                out.append(side() if r.random() < 0.5 else notice())
        return "".join(out)

    def bare() -> str:
        """A text without any element of its own, or in few."""
        kind = r.random()
        s = " ".join(_sentence(r, 3, 40) for _ in range(r.randint(1, 4)))
        if kind < 0.3:
            return text(1, s)
        if kind < 0.6:
            return f"<p>{text(1, s)}</p>"
        return "".join(f"<p>{text(1, _sentence(r, 3, 60))}</p>" for _ in range(r.randint(1, 6)))

    def marks() -> str:
        """Footing and menus that no name tells apart."""
        kind = r.random()
        if kind < 0.5:
            return f"<p>{text(0, r.choice(['&copy; ', 'Copyright ', '(c) ', 'All rights reserved. ']) + _sentence(r, 1, 6))}</p>"
        return f"<ul>{links(r.randint(3, 8))}</ul>"

    def optional(*parts, p: float = 0.5) -> str:
        return "".join(x() for x in r.sample(parts, len(parts)) if r.random() < p)

    shell = r.random()
    if shell < 0.3:  # few parts or none around the text
        top = optional(header, menu, notice, p=0.2)
        inner = bare() if r.random() < 0.6 else article()
        tag, name = r.choice(["article", "main", "div", "div", "section", "", "", "td"]), r.choice(["", "", ' class="x1"', ' id="c"'])
        inner = f"<table><tr><td>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{name}>{inner}</{tag}>" if tag else inner
        bottom = optional(comments, footer, marks, side, p=0.25)
        page = f"{top}{inner}{bottom}"
        return r.choice([page, f"<html><body>{page}</body></html>", f'<!DOCTYPE html><body class="home has-sidebar">{page}']), labels
    if shell < 0.36:  # no text of its own
        return f"<html><body>{optional(header, menu, notice, form, advert, p=0.6)}{optional(side, comments, footer, p=0.6)}</body></html>", labels
    top = optional(header, menu, notice, form, advert, p=0.55)
    wrap = r.choice(["article", "article", "article", "main", "div", "section"])
    name = attrs("post", "content", "entry") if wrap != "div" else r.choice([' class="content"', ' id="main"', ' class="post-body"', ""])
    body = f"<{wrap}{name}>{article()}</{wrap}>"
    if r.random() < 0.2:
        body = f"<main>{body}</main>"
    if r.random() < 0.3:
        body = f'<div id="wrapper">{body}</div>'
    bottom = optional(comments, side, advert, form, p=0.35)
    bottom += footer() if r.random() < 0.8 else ""
    head = f"<head><title>{_prose(r, 4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head if r.random() < 0.8 else ''}<body>{top}{body}{bottom}</body></html>", labels


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]


@lru_cache(maxsize=4)
def trained(n: int = TRAINING_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, once for the same parameters. Pages whose blocks and labels don't match one to one, as broken layouts may, aren't learned from."""
    pages = [(featured(blocks(p)), y) for p, y in labelled_pages(n, seed)]
    return train([(f, y) for f, y in pages if len(f) == len(y)])


def main_text(weights: np.ndarray, moves: np.ndarray, page: str | None) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, viterbi(weights, moves, featured(found)), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none) and n_chars."""
    weights, moves = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(weights, moves, x.as_py()) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return in_small_batches(narrow).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
