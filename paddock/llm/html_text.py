"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A logistic classifier gives each block's log-odds of being content from its own
text and markup; they become its capacities to the two terminals.  Neighbouring blocks, and blocks that share a
parent, are tied by smoothness edges, whose weights are fitted with the classifier (by pseudo-likelihood: how much the
true labels of a block's neighbours add to what the classifier says of it).  The minimum cut separates content from the
rest.  Blocks whose own cost outweighs all their ties are settled first (which changes no minimum), so the flow
runs over the uncertain ones.  Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import text_slices
from paddock.llm.toxicity import logistic

#: Element kinds of HTML, and names that pages give to what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes".split())
CONTROLS = frozenset("button select option".split())
EMBEDDED = frozenset("noscript svg".split())
SPACED = frozenset("br button select text desc".split())  #: inline elements whose text doesn't run on from the text before
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SECTIONS = frozenset("article aside body footer form header main nav section".split())
BARE = frozenset("nav footer aside form header menu dialog".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|sidebar|side|menu|nav\w*|breadcrumbs?|comments?|disqus|discussion|respon(?:d|ses?)|thread|repl(?:y|ies)|footer|header|masthead|topbar|login|signup|widget|pag(?:er|ination)|search|copyright|disclaimer|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
GOOD_HINTS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# Words, in the languages of the pages, that boilerplate says of itself.
LEGAL = re.compile(r"©|\(c\)\s*\d{4}|\b(?:copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos)\b", re.I)
NOTICE = re.compile(r"\b(?:cookies?|newsletter|subscribe|sign (?:up|in)|log ?in|register|privacy policy|terms of|advertis\w+|sponsored|share (?:this|on)|follow us|accept all|anmelden|abonnieren|datenschutz|anzeige|werbung|s'abonner|connexion|publicité|confidentialité|suscr\w+|iniciar sesión|publicidad|privacidad)\b", re.I)
REMARK = re.compile(r"\b(?:repl(?:y|ies)|commented|comments?|responses?|says|wrote|posted|ago|antwort\w*|kommentar\w*|répond\w+|commentaires?|respond\w+|comentarios?)\b", re.I)
ELSEWHERE = re.compile(r"^\W*(?:\d+\s+)?(?:comments?|responses?|repl(?:y|ies)|discussion|related|see also|read (?:more|next)|more (?:from|on)|recommended|share|newsletter|kommentare|mehr zum thema|commentaires|à lire aussi|comentarios|leer también)\b", re.I)
FEATURES = 26


class Node:
    """An open element: what its subtree is, by its own and its ancestors' names."""

    __slots__ = ("article", "bare", "control", "embedded", "foreign", "good", "hinted", "link", "name", "parent", "section")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.parent = name, parent
        hinted = bad = good = False
        article = name in ("article", "main")
        if attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    bad = True
                elif key == "role":
                    bad |= value in ("navigation", "banner", "contentinfo", "complementary", "alert", "search", "dialog")
                    article |= value in ("main", "article")
                else:
                    hinted |= bool(HINTS.search(value))
                    good |= bool(GOOD_HINTS.search(value))
        up = parent
        self.bare = (up.bare if up else False) or bad or name in BARE
        self.hinted = (up.hinted if up else False) or hinted
        self.article = (up.article if up else False) or article
        self.good = (up.good if up else False) or good or article
        self.link = (up.link if up else False) or name == "a"
        # a block inside one of these is a block like any other, so that a missing end tag marks nothing beyond it
        inline = up is not None and name not in BLOCK
        self.control = name in CONTROLS or (inline and up.control)
        self.embedded = name in EMBEDDED or (inline and up.embedded)
        self.foreign = name in ("svg", "math") or (inline and up.foreign and name != "foreignobject")
        self.section = self if name in SECTIONS or hinted or up is None else up.section


@dataclass
class Block:
    text: str
    linked: int  #: characters inside links
    controls: int  #: characters inside buttons and lists of options
    embedded: int  #: characters inside drawings and text for browsers without scripts
    parent: Node  #: the block element that holds it
    heading: bool
    form: bool = False  #: after a field of a form, or before one


class _Tags:
    """The tags of a page in order, each place of which is looked at a bounded number of times, whatever the markup."""

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.open_ended: set[int] = set()  # places from which on quotes don't come out even before a tag's end

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, whether it is an end tag, name, attributes) of the first tag from ``at`` on; comments and declarations
        have no name, and a comment may have no end.  None: the rest is text."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, False, "", ""
            if begin > self.last_end:  # nothing ends any more, but a comment that has no end may come
                begin = page.find("<!--", begin)
                return None if begin < 0 else (begin, len(page), False, "", "")
            closes = page.startswith("/", begin + 1)
            name = NAME.match(page, begin + 1 + closes)
            if name:
                end = self.end_of(name.end())
                return begin, end, closes, name[0].lower(), page[name.end() : end - 1]
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                return begin, page.find(">", begin) + 1, False, "", ""
            at = begin + 1
        return None

    def end_of(self, at: int) -> int:
        """Where the tag with attributes from ``at`` on ends: at the first > outside of quotes, or where quotes don't come
        out even, at the first one."""
        first, seen = at, []
        while at not in self.open_ended:
            seen.append(at)
            m = QUOTE_OR_END.search(self.page, at)
            if m and m[0] == ">":
                return m.end()
            at = self.page.find(m[0], m.end()) + 1 if m else 0
            if not at:
                break
        self.open_ended.update(seen)
        return self.page.find(">", first) + 1


class _Open:
    """The open elements, with the places of those that tags ask for, so that none searches through them."""

    BARRIERS = frozenset("ul ol dl table menu".split()) | SECTIONS

    def __init__(self, top: Node):
        self.stack = [top]
        self.by_name: dict[str, list[int]] = {}
        self.kinds = {kind: [] for kind in (BLOCK, SECTIONS, self.BARRIERS)}
        self.kinds[BLOCK].append(0)

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.by_name.setdefault(node.name, []).append(k)
        for names, places in self.kinds.items():
            if node.name in names:
                places.append(k)

    def cut(self, k: int) -> None:
        """Closes the element at place ``k`` and all in it."""
        while len(self.stack) > k:
            node = self.stack.pop()
            self.by_name[node.name].pop()
            for places in self.kinds.values():
                if places and places[-1] == len(self.stack):
                    places.pop()

    def last(self, name: str) -> int:
        """The place of the last open element of a name; 0 without one."""
        places = self.by_name.get(name)
        return places[-1] if places else 0

    def close(self, name: str, within: frozenset[str] | None) -> bool:
        """Closes the last element of a name unless one of the kind ``within`` has been opened since."""
        k = self.last(name)
        closes = k > 0 and not (within is not None and self.kinds[within] and self.kinds[within][-1] > k)
        if closes:
            self.cut(k)
        return closes

    @property
    def holder(self) -> Node:
        return self.stack[self.kinds[BLOCK][-1]]


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, in time that follows its length.  Scripts, styles and other RAW elements have none up to
    their end tags; missing end tags are implied as browsers do for paragraphs and items, and unknown markup is dropped.
    A script or style without an end tag is the rest of the page, as in browsers; of any other RAW element without
    one only the tag is dropped.  The head is no element of its own: what it may hold has no text, and it ends where
    text begins."""
    top = Node("html", "", None)
    tags, opened, out = _Tags(page), _Open(top), []
    stack = opened.stack
    held, linked, controls, embedded = [], 0, 0, 0
    holder = top
    endless = set()  # RAW elements without an end tag from here on

    def flush():
        nonlocal held, linked, controls, embedded
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                n = len(text)
                out.append(Block(text, min(linked, n), min(controls, n), min(embedded, n), holder, holder.name in ("h1", "h2", "h3", "h4", "h5", "h6")))
            held, linked, controls, embedded = [], 0, 0, 0

    at, n = 0, len(page)
    while at < n:
        tag = tags.next(at)
        end = tag[0] if tag else n
        if end > at:
            held.append(page[at:end])
            if stack[-1].link:
                linked += end - at
            if stack[-1].control:
                controls += end - at
            if stack[-1].embedded:
                embedded += end - at
        if not tag:
            break
        _, at, closes, name, attributes = tag
        if not name:
            continue
        if name in SPACED:
            held.append(" ")
        if closes:
            # an end tag doesn't reach out of its section
            k = opened.last(name)
            if k and (name in SECTIONS or not opened.kinds[SECTIONS] or opened.kinds[SECTIONS][-1] < k):
                if name in BLOCK:
                    flush()
                opened.cut(k)
                holder = opened.holder
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") and name not in endless:
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                ends = page.find(">", close.end()) if close else -1
                if ends >= 0:
                    at = ends + 1
                elif name in ("script", "style"):
                    at = n
                else:
                    endless.add(name)
        elif name == "head":
            flush()
        elif (name in ("svg", "math") or stack[-1].foreign) and attributes.rstrip().endswith("/"):
            continue
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            if name in BLOCK:
                flush()
                if name in CLOSES_P or name == "p":
                    opened.close("p", BLOCK)
                if name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    opened.close(name, _Open.BARRIERS)
            if name == "a" and stack[-1].link:
                opened.close("a", None)
            if name == "button" and stack[-1].control:
                opened.close("button", BLOCK)
            node = Node(name, attributes, stack[-1])
            opened.push(node)
            if name in BLOCK:
                holder = node
    flush()
    return out


def _below(found: list[Block]) -> list[bool]:
    """Whether a block follows a heading that announces something else, inside what holds this heading."""
    out, stop = [], None
    for b in found:
        if b.heading:
            stop = b.parent.parent if ELSEWHERE.search(b.text) and len(b.text) < 60 else None
            out.append(stop is not None)
            continue
        up, steps = b.parent, 0
        while stop is not None and up is not None and up is not stop and steps < 40:
            up, steps = up.parent, steps + 1
        if stop is not None and up is not stop:
            stop = None
        out.append(stop is not None)
    return out


def features(found: list[Block]) -> np.ndarray:
    """What a block's own text and markup say, and whether the page marks an article elsewhere."""
    x = np.zeros((len(found), FEATURES))
    clean = [b.parent.good and not (b.parent.bare or b.parent.hinted) for b in found]
    marked, hinted = any(c and b.parent.article for c, b in zip(clean, found)), any(clean)
    for row, b, own, below in zip(x, found, clean, _below(found)):
        n = len(b.text)
        words = b.text.count(" ") + 1
        stops = sum(map(b.text.count, ".,;:!?"))
        linked = min(1.0, b.linked / n)
        short = n < 400
        row[:] = (
            b.parent.bare,
            b.parent.hinted,
            b.parent.good,
            own,
            marked and not b.parent.article,
            hinted and not own,
            linked,
            linked > 0.9,
            min(n, 400) / 400,
            min(words, 60) / 60,
            words <= 4,
            1 < words <= 8 and all(w[0].isupper() for w in b.text.split(" ")),
            b.heading,
            min(stops, 8) / 8,
            min(1.0, 8 * stops / words),
            b.text[-1] in ".!?…:»”\"'",
            b.parent.name in ("li", "th", "option", "dt", "dd"),
            b.parent.name in ("p", "blockquote", "pre"),
            b.parent.name in ("div", "body", "html", "section"),
            b.parent.name == "td",
            b.controls / n,
            b.embedded / n,
            short and bool(LEGAL.search(b.text)),
            short and bool(NOTICE.search(b.text)),
            words <= 12 and bool(REMARK.search(b.text)),
            below,
        )
    return x


TIES = 8


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, block, kind).  Kinds: neighbours under one parent or parent's parent (0), others of one
    section (1), the next block with the same parent's parent (2), neighbours in two sections (3); 4 more where one
    block is mostly links and the other isn't."""
    out, last = [], {}
    unlike = lambda a, b: (2 * a.linked > len(a.text)) != (2 * b.linked > len(b.text))
    for i, b in enumerate(found):
        up = id(b.parent.parent)
        if i:
            other = found[i - 1]
            if other.parent.section is not b.parent.section:
                kind = 3
            elif other.parent is b.parent or id(other.parent.parent) == up:
                kind = 0
            else:
                kind = 1
            out.append((i - 1, i, kind + 4 * unlike(other, b)))
        if up in last and last[up] < i - 1 and found[last[up]].parent.section is b.parent.section:
            out.append((last[up], i, 2 + 4 * unlike(found[last[up]], b)))
        last[up] = i
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise: -cost of each node labelled False with a positive cost, and |cost| of each labelled
    True with a negative one, plus the weight of every edge between unequal labels.  Ties go to False."""
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    own, slack = list(costs), [sum(w for _, w in e) for e in near]
    label: list[bool | None] = [None] * n
    ready = deque(range(n))
    while ready:  # settle nodes that their ties can't turn; a settled node moves its ties into its neighbours' costs
        i = ready.popleft()
        if label[i] is None and abs(own[i]) > slack[i] + 1e-12:
            label[i] = own[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    slack[j] -= w
                    ready.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _flow(left, own, near, label)):
            label[i] = content
    return [bool(x) for x in label]


def _flow(nodes: list[int], own: list[float], near, label) -> list[bool]:
    """Maximum flow by blocking flows over levels, of the unsettled nodes; True on the source's side.  Ties reach few
    blocks far, so paths are short, and with them the number of levels and the time for each block."""
    at = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    to, room, arcs = [], [], [[] for _ in range(len(nodes) + 2)]

    def tie(u: int, v: int, there: float, back: float) -> None:
        for end, other, r in ((u, v, there), (v, u, back)):
            arcs[end].append(len(to))
            to.append(other)
            room.append(r)

    for i in nodes:
        k = at[i]
        if own[i] > 0:
            tie(source, k, own[i], 0.0)
        elif own[i] < 0:
            tie(k, sink, -own[i], 0.0)
        for j, w in near[i]:
            if label[j] is None and i < j:
                tie(k, at[j], w, w)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for e in arcs[x]:
                if room[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if sink not in level:
            return [k in level for k in range(len(nodes))]
        turn = [0] * len(arcs)  # arcs before this one lead nowhere in these levels
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, x = [], source
                continue
            while turn[x] < len(arcs[x]):
                e = arcs[x][turn[x]]
                if room[e] > 1e-9 and level.get(to[e]) == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                turn[x] += 1
            else:
                if not path:
                    break
                x = to[path.pop() ^ 1]
                turn[x] += 1


@dataclass(frozen=True)
class Model:
    """The block classifier's weights (its bias last) and the weight of each kind of edge."""

    weights: np.ndarray
    ties: np.ndarray

    def odds(self, found: list[Block]) -> np.ndarray:
        return np.clip(features(found) @ self.weights[:-1] + self.weights[-1], -12, 12)

    def labels(self, found: list[Block], cut: bool = True) -> list[bool]:
        """Which blocks are content: by the minimum cut, or by each block's own odds alone."""
        odds = self.odds(found)
        if not cut:
            return (odds > 0).tolist()
        return minimum_cut(odds.tolist(), [(i, j, float(self.ties[kind])) for i, j, kind in ties(found)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(found, model.labels(found)) if keep) if found else ""


TRAINING_PAGES = 1_200
#: The part of the fitted ties that the cut uses: fitting takes the labels around a block as known, cutting doesn't know
#: them.  Between a quarter and all of it, half is the best on layouts that are left out of training.
TIE_SHARE = 0.5


class _Pages:
    """Draws labelled pages: pieces of markup with the label of each of their blocks."""

    #: Names that say nothing.
    NAMES = "wrap inner box col row x1 c-12 grid block holder unit pane cell lead zone area part outer frame".split()
    SMALL_PRINT = ["&copy; 2024 {w}", "Copyright 2019 {w} Inc", "&copy; {w}.example &middot; {p}", "(c) 2021 {w}. All rights reserved.", "{w} - Alle Rechte vorbehalten", "Tous droits réservés {w}", "Todos los derechos reservados", "{p} Copyright {w}"]
    NOTICES = ["We use cookies. {p}", "Subscribe to our newsletter", "Sign up for {w}", "Log in", "Share this", "Follow us on {w}", "Advertisement", "Sponsored {p}", "Diese Seite nutzt Cookies. {p}", "Newsletter abonnieren", "Anzeige", "Publicité", "S'abonner", "Publicidad {w}", "Accept all", "{p} privacy policy {w}"]
    BYLINES = ["{w} {w} wrote:", "{w} says", "Posted by {w}", "3 days ago", "Reply", "{w} commented", "2 replies", "Antworten", "Répondre", "Responder"]
    ABOUT_OTHERS = ["Comments", "3 Comments", "Responses", "12 replies", "Discussion", "Related", "Read more", "Share", "Kommentare", "Commentaires", "Comentarios"]

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(["a", "e", "i", "o", "n", "r", "s", "t", "th", "er", "en", "é", "ü", "ci", "l", "u"], k=self.rng.randint(1, 6)))

    def say(self, least: int, most: int) -> str:
        text = " ".join(self.word() for _ in range(self.rng.randint(least, most)))
        return self.rng.choice([text, text.capitalize(), text.capitalize(), text.title()])

    def prose(self, most: int = 8) -> str:
        rng = self.rng
        return " ".join(self.say(1, 18).capitalize() + rng.choice([".", ".", ".", ",", "?", "!", ""]) for _ in range(rng.randint(1, most)))

    def phrase(self, given: list[str]) -> str:
        return re.sub(r"\{([wp])\}", lambda m: self.say(1, 2) if m[1] == "w" else self.prose(2), self.rng.choice(given))

    def named(self, *names: str) -> str:
        """Attributes: one of the names, or none."""
        return f' {self.rng.choice(["class", "id"])}="{self.rng.choice(names)}"' if names else ""

    def menu(self, plain: bool) -> tuple[str, list[bool]]:
        rng, k = self.rng, self.rng.randint(2, 8)
        links = [f'<a href="/{i}">{self.say(1, 3)}</a>' for i in range(k)]
        as_list = rng.random() < 0.6
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if as_list else rng.choice([" ", " | ", " &middot; "]).join(links)
        if not as_list and rng.random() < 0.25:
            inner = " ".join(self.say(1, 1).capitalize() for _ in range(k))  # links made by scripts: words alone
        flags = [False] * (k if as_list else 1)
        tag = "div" if plain else rng.choice(["nav", "header", "div class=menu", 'div id="top-nav"', 'ul class="navbar"' if not as_list else "nav"])
        return f"<{tag}{self.named(*self.NAMES) if plain and rng.random() < 0.5 else ''}>{inner}</{tag.split()[0]}>", flags

    def body(self, plain: bool) -> tuple[str, list[bool]]:
        """What an article holds, with a few boxes that don't belong to it."""
        rng, out, flags = self.rng, "", []
        if rng.random() < 0.85:
            out, flags = rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<p><b>{}</b></p>"]).format(self.say(1, 12)), [True]
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.62:
                made = (f"<p>{self.prose()}</p>", [True])
            elif kind < 0.72:
                made = (f"<p>{self.say(1, 4)}{rng.choice(['.', '', '!'])}</p>", [True])
            elif kind < 0.77:
                made = (f"<ul><li>{self.prose(2)}</li><li>{self.say(1, 6)}</li><li>{self.say(1, 3)}</li></ul>", [True] * 3)
            elif kind < 0.83:
                made = (f"<{rng.choice(['h2', 'h3'])}>{self.say(1, 6)}</h2>", [True])
                made = (made[0].replace("</h2>", "</" + made[0][1:3] + ">"), [True])
            elif kind < 0.87:
                made = (f'<p>{self.say(1, 9)} <a href="/y">{self.say(1, 4)}</a> {self.prose(3)}</p>', [True])
            elif kind < 0.89:
                made = (f'<p><a href="/y">{self.say(2, 6)}</a></p>', [True])
            elif kind < 0.92:
                made = (f"<blockquote>{self.prose(2)}</blockquote>", [True])
            elif kind < 0.94:
                made = (f"<table><tr><td>{self.say(1, 3)}</td><td>{self.say(1, 4)}</td></tr></table>", [True, True])
            elif kind < 0.95:
                made = (rng.choice(["<p>{a} <button>{b}</button> {p}</p>", "<p>{a} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {p}</p>", "<p>{p} <noscript>{p}</noscript></p>"]).format(a=self.say(3, 9), b=self.say(1, 2), p=self.prose(3)), [True])
            elif kind < 0.957 and not plain:  # an article may speak of such things, or name its parts like them
                told = self.phrase(self.SMALL_PRINT + self.NOTICES + self.BYLINES)
                made = rng.choice([(f"<p>{told} {self.say(1, 9)}</p>", [True]), (f"<p>{self.prose(3)} {told}</p>", [True]), (f"<h2>{rng.choice(self.ABOUT_OTHERS)}</h2><p>{self.prose(3)}</p>", [True, True])])
            elif kind < 0.966:
                made = (f"<hr><button>{self.say(1, 3)}</button><hr>", [False])
            elif plain:
                made = (f"<div>{self.phrase(self.NOTICES)}</div>", [False])
            else:
                made = (f'<div class="{rng.choice(["advert", "share", "related-links", "newsletter", "ad"])}">{self.say(2, 12)}</div>', [False])
            out, flags = out + made[0], flags + made[1]
        return out, flags

    def boxes(self, plain: bool) -> tuple[str, list[bool]]:
        rng = self.rng
        if plain:
            return f"<div>{self.phrase(self.NOTICES)}</div>", [False]
        return rng.choice(['<div class="ad">{p}</div>', '<div class="cookie-notice"><p>{p}</p></div>', "<aside><p>{p}</p></aside>", '<div class="sponsored">{s}</div>', "<form><label>{s}</label></form>", '<div id="sidebar"><p>{p}</p></div>', "<noscript>{s}</noscript><hr>", "<svg><text>{s}</text></svg><hr>", '<section class="widget">{s}</section>']).format(p=self.prose(3), s=self.say(1, 12)), [False]

    def remarks(self, plain: bool) -> tuple[str, list[bool]]:
        """What readers said: under a heading where nothing else tells."""
        rng, out, flags = self.rng, "", []
        if plain or rng.random() < 0.5:
            out, flags = f"<h3>{rng.choice(self.ABOUT_OTHERS)}</h3>", [False]
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.6:
                out, flags = out + f"<p>{self.phrase(self.BYLINES)}</p>", [*flags, False]
            out, flags = out + f"<p>{self.prose(3)}</p>", [*flags, False]
        tag = "div" if plain else rng.choice(['div class="comments"', 'section class="responses"', 'section id="discussion"', 'ol class="thread"', 'div id="disqus"', "section"])
        if tag == "section" and not out.startswith("<h3>"):
            out, flags = f"<h3>{rng.choice(self.ABOUT_OTHERS)}</h3>" + out, [False, *flags]
        return f"<{tag}>{out}</{tag.split()[0]}>", flags

    def footer(self, plain: bool) -> tuple[str, list[bool]]:
        rng = self.rng
        text = self.phrase(self.SMALL_PRINT) if plain or rng.random() < 0.6 else self.prose(2)
        if plain:
            return rng.choice(["<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>"]).format(text), [False]
        return rng.choice(["<footer>{}</footer>", '<div id="footer"><p>{}</p></div>', "<footer><p>{}</p></footer>", '<div class="copyright">{}</div>']).format(text), [False]

    def page(self, layout: str) -> tuple[str, list[bool]]:
        rng = self.rng
        plain = layout in ("divs", "table", "names", "breaks")
        made: list[tuple[str, list[bool]]] = []
        if rng.random() < 0.9:
            made.append(self.menu(plain))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            made.append(self.boxes(plain))
        body, flags = self.body(plain)
        if layout == "article":
            body = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', "<main><article>{}</article></main>"]).format(body)
        elif layout == "hints":
            body = f'<div{self.named("content", "post-body", "article-text", "main", "entry", "story")}>{body}</div>'
        elif layout == "sections":
            body = f"<section>{body}</section>"
        elif layout == "names":
            body = f"<div{self.named(*self.NAMES)}><div{self.named(*self.NAMES)}>{body}</div></div>"
        elif layout == "table" and rng.random() < 0.3:
            body, flags = f"<div>{self.prose(9)}<br>{self.prose(9)}</div>", [True]
        elif layout == "breaks":
            k = rng.randint(1, 6)
            body, flags = f"<h1>{self.say(2, 9)}</h1><div>" + "<hr>".join(self.prose(5) if rng.random() < 0.8 else self.say(1, 5) for _ in range(k)) + "</div>", [True] * (k + 1)
        else:
            body = f"<div>{body}</div>"
        made.append((body, flags))
        if rng.random() < 0.4:
            made.append(self.remarks(plain))
        if rng.random() < 0.85:
            made.append(self.footer(plain))
        if layout == "table":
            bare = lambda m: re.sub(r"^<div[^>]*>(.*)</div>$", r"\1", m) if rng.random() < 0.5 else m
            rows = [f"<td>{bare(m)}</td>" for m, _ in made]
            if rng.random() < 0.5:
                inner = "<tr>" + "".join(rows) + "</tr>"
            else:
                inner = "".join(f"<tr>{r}</tr>" for r in rows)
            return f"<html><body><table>{inner}</table></body></html>", [f for _, fs in made for f in fs]
        wrap = rng.choice(["{}", "{}", "<div>{}</div>", "<div><div>{}</div></div>"])
        return "<html><body>" + wrap.format("".join(m for m, _ in made)) + "</body></html>", [f for _, fs in made for f in fs]


LAYOUTS = ("article", "hints", "sections", "divs", "table", "names", "breaks")


def training_pages(n: int = TRAINING_PAGES, seed: int = 3, layouts: tuple[str, ...] = LAYOUTS) -> Iterator[tuple[str, list[bool]]]:
    """Made-up pages with the label of each of their blocks: marked articles, telling and meaningless class names, plain
    sections, divisions and tables, text between rules; with menus, boxes, notices, readers' remarks and small print."""
    made = _Pages(seed)
    for k in range(n):
        yield made.page(layouts[k % len(layouts)])


def fit(pages: Iterator[tuple[str, list[bool]]] | None = None, folds: int = 3) -> Model:
    """Classifier and ties from labelled pages (about a thousand; TRAINING_PAGES by default, which bounds them)."""
    xs, ys, edges = [], [], []
    for page, labels in pages or training_pages():
        found = blocks_of(page)
        if found and len(found) == len(labels):
            xs.append(features(found))
            ys.append(np.array(labels, float))
            edges.append(ties(found))
    x, y = np.concatenate(xs), np.concatenate(ys)
    fold = np.repeat(np.arange(len(xs)) % folds, [len(v) for v in ys])
    odds = np.zeros(len(y))
    for k in range(folds):
        w = logistic(x[fold != k], y[fold != k], ridge=0.3)
        odds[fold == k] = np.clip(x[fold == k] @ w[:-1] + w[-1], -12, 12)
    # what the labels of a block's neighbours, by kind of edge, add to its own odds
    near, start = np.zeros((len(y), TIES)), 0
    for v, page_edges in zip(ys, edges):
        for i, j, kind in page_edges:
            near[start + i, kind] += 2 * v[j] - 1
            near[start + j, kind] += 2 * v[i] - 1
        start += len(v)
    own = logistic(np.column_stack([odds, near]), y, ridge=1.0)
    weights = logistic(x, y, ridge=0.3) * own[0]
    weights[-1] += own[-1]
    return Model(weights, TIE_SHARE * np.maximum(own[1:-1], 0))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every whole page.

    Character references are decoded, white space inside a block becomes one space and blocks are joined by one.
    A null or empty page, or one without content, has an empty text; repeated rows come back repeated; null ids
    and urls stay null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2, 4_000_000):
            texts = [main_text(p, model) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
