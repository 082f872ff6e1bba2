"""Main text of HTML pages by a tree-structured graphical model.

The DOM's nodes carry hidden variables (content or not). Node potentials come from features of a node (tag, words of its class and
id, text and link lengths below it, depth), edge potentials from parent and child states; sum-product messages pass up to the
root and down again and give each node's exact marginal. Weights are trained by maximum likelihood on labelled pages: TRAIN_PAGES
pages written from varied layouts by ``labelled_pages``, whose truth is known. Text blocks with a marginal over one half make
the main text.

Defined results: null html is empty and gives an empty text. Every row is judged by itself, repeated or without page_id. A ``<`` whose tag
has no end is text. Time and memory grow with the page's length, whatever its markup is. Formulas are text; what noscript, canvas, object
and iframe hold for browsers that can't show them is not, since the page does not show it.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import ship_package

TRAIN_PAGES = 160
ROUNDS = 25
PAGE_NODES = 60
_TAG_PATTERN = r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_TOKEN = re.compile(_TAG_PATTERN + r"|<![^>]*>|<\?[^>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements without text to read; those that reach to the end of the page if they are not closed come first.
_REACHING = ("script", "style", "textarea", "title")
_HOLDING = frozenset("noscript template svg iframe select object canvas".split())
_FOREIGN = frozenset(("svg",))
#: Where svg holds HTML again, and the HTML that ends it elsewhere.
_INTEGRATED = frozenset("foreignobject desc title".split())
_BREAKS = frozenset(
    "address article aside b big blockquote body br center code dd details div dl dt em embed fieldset figcaption figure font footer form"
    " h1 h2 h3 h4 h5 h6 header hr i img input li listing main menu meta nav nobr ol p pre ruby s section small span strike strong"
    " sub sup table tbody td th tr tt u ul var".split()
)
_IN_SELECT = frozenset(("option", "optgroup", "hr"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements are part of their block; everything else begins a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mo mn ms mtext msup msub"
    " msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mspace".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split()
)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Longer headings are titles, not names of parts.
HEADING_CHARS = 32
_FURNITURE = frozenset(("nav", "aside", "footer", "form"))
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    depth: int
    text: list[str] = field(default_factory=list)  # of a text block only
    linked: int = 0
    chars: int = 0
    truth: int = 0
    kids: list[int] = field(default_factory=list)
    under: str = ""  # the nearest of _FURNITURE that the node is in


def _settled(page: str, start: int) -> str:
    """The page with every ``<`` from ``start`` on that begins a tag without an end as a character reference.

    A tag ends at the next ``>`` outside of quotes. Whether there is one follows, from the page's end backwards, from what comes after
    the next quoted part, so one pass settles it for all tags and no later search reads to the end of the page in vain.
    """
    events = [match.start() for match in _EVENT.finditer(page, start)]
    ends = [False] * (len(events) + 1)
    following: dict[str, int] = {}
    for i in range(len(events) - 1, -1, -1):
        char = page[events[i]]
        if char == ">":
            ends[i] = True
        else:
            ends[i] = char in following and ends[following[char] + 1]
            following[char] = i
    parts, done, i, last = [], 0, 0, page.rfind(">")
    for match in _START.finditer(page, start):
        at = match.start()
        while i < len(events) and events[i] < at:
            i += 1
        if not (at < last if page[at + 1] in "!?" else ends[i]):
            parts += page[done:at], "&lt;"
            done = at + 1
    return "".join([*parts, page[done:]])


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and texts of the page; settled from the first tag without an end on."""
    at = 0
    while True:
        for match in _TOKEN.finditer(page, at):
            if match[4] == "<" and _START.match(page, match.start()):
                at = match.start()
                page = _settled(page, at)
                break
            yield match
        else:
            return


def _cut_raw(page: str) -> str:
    """The page without elements that never hold text to read.

    Script, style, textarea and title reach to their closing tag or the end of the page. Of other elements an open one loses its
    tag only, and svg and select end where a tag can't stand in them. What a head holds besides these is page, as in browsers.
    """
    cuts: list[tuple[int, int]] = []
    held: list[_Open] = []
    many = dict.fromkeys((*_HOLDING, *_INTEGRATED), 0)  # of each tag in held
    at = 0
    while match := _TAG.search(page, at):
        start, at = match.span()
        closing, tag, rest = match.groups()
        if tag is None and at == start + 1:
            page, at = _settled(page, start), start
            continue
        tag = (tag or "").lower()
        empty = (rest or "").endswith("/")
        top = held[-1] if held else None
        foreign = top is not None and top.tag in _FOREIGN
        if not tag or tag == "head":
            cuts.append((start, at))
        elif tag in _REACHING and not closing and not (foreign and (empty or tag == "title")):
            end = _CLOSING[tag].search(page, at)
            at = end.end() if end else len(page)
            cuts.append((start, at))
        elif tag in _HOLDING or tag in _INTEGRATED and many["svg"]:
            if not closing:
                if not empty or not (tag in _FOREIGN or foreign):
                    held.append(_Open(tag, start, at))
                    many[tag] += 1
                else:
                    cuts.append((start, at))
            elif many[tag]:
                while (last := held.pop()).tag != tag:
                    many[last.tag] -= 1
                many[tag] -= 1
                cuts.append((last.start, at))
        elif top is not None and (foreign or top.tag == "select"):
            if closing:
                ends = not top.inside.get(tag)
                top.inside[tag] = top.inside.get(tag, 0) - 1
            else:
                ends = tag in _BREAKS if foreign else tag not in _IN_SELECT
                top.inside[tag] = top.inside.get(tag, 0) + (not empty)
            if ends and foreign:
                cuts.append((top.start, start))
                many[held.pop().tag] -= 1
                at = start
            elif ends and top.until is None:  # a closed select may hold other tags
                top.until = start
    cuts += [(o.start, o.until or o.end) for o in held]
    cuts.sort()
    parts, done = [], 0
    for start, end in cuts:
        if start >= done:
            parts += page[done:start], " "
        done = max(done, end)
    return "".join([*parts, page[done:]])


@dataclass
class _Open:
    tag: str
    start: int
    end: int
    until: int | None = None
    inside: dict[str, int] = field(default_factory=dict)


#: A tag, a comment, or the start of a tag that has no end.
_TAG = re.compile(_TAG_PATTERN + r"|<(?=/?[a-zA-Z])", re.S)
_START = re.compile(r"<(?=/?[a-zA-Z]|\?|!(?!--))")
_EVENT = re.compile(r"[>\"']")
_CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _REACHING}


def parse(page: str) -> list[Node]:
    """Elements and, below them, text blocks (tag ``#text``) in page order; malformed markup is read leniently."""
    nodes = [Node("#root", (), -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # inline elements stand for the block they are in
    places: dict[str, list[int]] = {}  # of each tag, and of all blocks as "", in the stack
    block: Node | None = None
    links = 0

    def close(place: int) -> None:
        nonlocal block, links
        for tag, _ in stack[place:]:
            if tag == "a":
                links = max(0, links - 1)
            places[tag].pop()
            if tag not in _INLINE:
                places[""].pop()
                block = None
        del stack[place:]

    def opened(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            places.setdefault("", []).append(len(stack))
        stack.append((tag, node))

    def last(*tags: str) -> int:
        return max(places[tag][-1] if places.get(tag) else 0 for tag in tags)

    for match in _tokens(_cut_raw(page)):
        closing, tag, rest, text = match.groups()
        if text is not None:
            if block is None and text.isspace():
                continue
            if block is None:
                parent = stack[-1][1]
                block = Node("#text", (), parent, nodes[parent].depth + 1, under=nodes[parent].under)
                nodes[parent].kids.append(len(nodes))
                nodes.append(block)
            block.text.append(text)
            if links:
                block.linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            place = last(tag)
            if place and (tag not in _INLINE or place > last("")):
                close(place)
            elif tag == "p":
                block = None
            continue
        if tag == "br":
            if block is not None:
                block.text.append(" ")
            continue
        if tag in _CLOSES_P and stack[last("")][0] == "p":
            close(last(""))
        if tag in _SAME and last(*_SAME[tag]) > last(*_SCOPES[tag]):
            close(last(*_SAME[tag]))
        if tag in _VOID:
            if tag not in _INLINE:
                block = None
            continue
        if tag in _INLINE:
            links += tag == "a"
            opened(tag, stack[-1][1])
        elif not rest.endswith("/") or tag in _CLOSES_P:
            block = None
            found = _ATTRIBUTE.findall(rest) if "=" in rest else []
            words = tuple(dict.fromkeys(_WORDS.findall(" ".join("".join(values) for _, *values in found).lower())))
            parent = stack[-1][1]
            nodes[parent].kids.append(len(nodes))
            nodes.append(Node(tag, words, parent, nodes[parent].depth + 1, under=tag if tag in _FURNITURE else nodes[parent].under))
            opened(tag, len(nodes) - 1)
    for node in nodes:
        if node.tag == "#text":
            raw = "".join(node.text)
            node.text = [_SPACE.sub(" ", entities.unescape(raw)).strip()]
            node.chars = len(node.text[0])
    for place in range(len(nodes) - 1, 0, -1):
        parent = nodes[nodes[place].parent]
        parent.chars += nodes[place].chars
        parent.linked += nodes[place].linked
    return nodes


def _bin(x: float) -> int:
    return min(7, int(math.log2(x + 1)))


def features(nodes: list[Node], place: int) -> list[str]:
    node = nodes[place]
    found = [f"tag={node.tag}", f"links={int(4 * node.linked / max(1, node.chars))}"]
    found.extend(f"word={word}" for word in node.words)
    if node.tag == "article":
        found.append(f"article in={nodes[node.parent].tag}")
    found.extend(f"head={word}" for word in _heading(nodes, node))
    if node.tag == "#text":
        parent = nodes[node.parent]
        found += [f"in={parent.tag}", f"under={node.under}", f"chars={_bin(node.chars / 8)}"]
    return found


def _heading(nodes: list[Node], node: Node) -> list[str]:
    """Words of the short heading that an element begins with: a part without a name often says there what it is."""
    first = nodes[node.kids[0]] if node.kids else node
    if first.tag not in _HEADINGS or len(first.kids) != 1 or first.chars > HEADING_CHARS:
        return []
    return list(dict.fromkeys(_WORDS.findall(" ".join(nodes[first.kids[0]].text).lower())))


Weights = dict[str, float]


def _scores(nodes: list[Node], weights: Weights) -> list[float]:
    """Log potential of content against no content for each node."""
    return [sum(weights.get(f, 0.0) for f in features(nodes, i)) for i in range(len(nodes))]


def _soft(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log(math.exp(a - high) + math.exp(b - high))


def marginals(nodes: list[Node], weights: Weights, scores: list[float] | None = None) -> tuple[list[float], dict[str, float]]:
    """P(content) of every node, and the expected counts of the edge states, by sum-product up and down the tree."""
    scores = scores if scores is not None else _scores(nodes, weights)
    edge = [[0.0, weights.get("edge01", 0.0)], [weights.get("edge10", 0.0), weights.get("edge11", 0.0)]]  # parent, child
    n = len(nodes)
    inner = [[0.0, s] for s in scores]  # a node's potential with all messages from below
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        zero, one = inner[i]
        up[i] = (_soft(edge[0][0] + zero, edge[0][1] + one), _soft(edge[1][0] + zero, edge[1][1] + one))
        above = inner[nodes[i].parent]
        above[0] += up[i][0]
        above[1] += up[i][1]
    outer = [(0.0, 0.0)] * n
    result, expected = [0.0] * n, {"edge01": 0.0, "edge10": 0.0, "edge11": 0.0}
    for i in range(n):
        zero, one = inner[i][0] + outer[i][0], inner[i][1] + outer[i][1]
        result[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, zero - one))))
        for kid in nodes[i].kids:
            rest0, rest1 = zero - up[kid][0], one - up[kid][1]
            outer[kid] = (_soft(rest0 + edge[0][0], rest1 + edge[1][0]), _soft(rest0 + edge[0][1], rest1 + edge[1][1]))
            joint = [[rest0 + edge[0][0] + inner[kid][0], rest0 + edge[0][1] + inner[kid][1]], [rest1 + edge[1][0] + inner[kid][0], rest1 + edge[1][1] + inner[kid][1]]]
            high = max(map(max, joint))
            table = [[math.exp(x - high) for x in row] for row in joint]
            total = sum(map(sum, table))
            expected["edge01"] += table[0][1] / total
            expected["edge10"] += table[1][0] / total
            expected["edge11"] += table[1][1] / total
    return result, expected


def train(pages: list[list[Node]], rounds: int = ROUNDS) -> Weights:
    """Maximum likelihood with a small ridge, page by page with steps scaled per weight; the mean of the later half of the rounds."""
    mean: Weights = {}
    later = rounds - rounds // 2
    weights: Weights = {"edge01": 0.0, "edge10": 0.0, "edge11": 0.0}
    squares: dict[str, float] = {}
    described = [[features(nodes, i) for i in range(len(nodes))] for nodes in pages]
    for number in range(rounds):
        for nodes, found in zip(pages, described, strict=True):
            scores = [sum(weights.get(f, 0.0) for f in own) for own in found]
            probability, expected = marginals(nodes, weights, scores)
            gradient: dict[str, float] = {}
            for node, own, p in zip(nodes, found, probability, strict=True):
                for f in own:
                    gradient[f] = gradient.get(f, 0.0) + node.truth - p
            for node in nodes[1:]:
                above = nodes[node.parent].truth
                if above or node.truth:
                    key = f"edge{above}{node.truth}"
                    gradient[key] = gradient.get(key, 0.0) + 1
            for key, value in expected.items():
                gradient[key] = gradient.get(key, 0.0) - value
            share = min(1.0, PAGE_NODES / len(nodes))  # a long page is no more than PAGE_NODES nodes of evidence
            for key, value in gradient.items():
                value = share * value - 0.01 * weights.get(key, 0.0)
                squares[key] = squares.get(key, 1e-3) + value * value
                weights[key] = weights.get(key, 0.0) + 0.5 * value / math.sqrt(squares[key])
        if number >= rounds - later:
            for key, value in weights.items():
                mean[key] = mean.get(key, 0.0) + value / later
    return mean


# Layouts of the training pages: words that class and id attributes take, by what the element is for.
_ASIDE_NAMES = {
    "menu": "menu nav navigation navbar topnav breadcrumb breadcrumbs pagination pager toolbar tabs",
    "header": "header masthead banner topbar logo branding site head",
    "footer": "footer foot bottom copyright colophon legal",
    "sidebar": "sidebar side aside widget widgets related recommended popular trending rail more",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense",
    "comments": "comments comment discussion replies reply respond disqus reader",
    "social": "share sharing social follow buttons",
    "form": "form search login contact field input",
}
#: Headings over readers' comments, and over parts of the page about other articles, that need not have a name.
_TALK = "{n} comments|comments|{n} replies|{n} responses|leave a reply|discussion|join the discussion|reader comments".split("|")
_BODY_NAMES = "article content post entry body main story text page single blog news".split()
_ASIDE_TAGS = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"),
               "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section"), "comments": ("section", "div", "ol"), "social": ("div", "ul"), "form": ("form",)}
_SYLLABLES = "ka lo mi ren tas vor el unt ish ga per do sta fin".split()


def _prose(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice((".", ".", ".", "", " |"))


def labelled_page(rng: random.Random) -> list[Node]:
    """One page; its article's text stands between marks that are taken out again as labels."""

    def mark(text: str) -> str:
        return f"\x02{text}"

    def named(kind: str) -> str:
        if rng.random() < 0.25:
            return ""
        names = rng.sample(_ASIDE_NAMES[kind].split(), rng.randint(1, 2))
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice((" ", "-", "_")).join(names)}"'

    def aside(kind: str) -> str:
        tag = rng.choice(_ASIDE_TAGS[kind])
        name = named(kind) if tag in ("nav", "header", "footer", "aside", "form") or rng.random() < 0.05 else ""
        while not name and tag in ("div", "section", "ul", "ol"):
            name = named(kind)
        item = "li" if tag in ("ul", "ol") else rng.choice(("p", "div", "span", ""))
        parts = []
        for _ in range(rng.randint(1, 6)):
            text = _prose(rng, *((1, 4) if kind in ("menu", "social", "header", "form") else (2, 40)))
            if kind in ("menu", "social") or kind in ("sidebar", "footer") and rng.random() < 0.5:
                text = f'<a href="#">{text}</a>'
            if kind == "form":
                text = f"<label>{text}</label><input name=q>"
            parts.append(f"<{item}>{text}</{item}>" if item else text)
        inside = "".join(parts)
        if kind == "menu" and tag != "ul" and rng.random() < 0.6:
            inside = "<ul>" + "".join(f"<li>{p}</li>" for p in parts) + "</ul>"
        if kind == "comments" and rng.random() < 0.5:
            inside = "<h3>" + _prose(rng, 1, 2) + "</h3>" + inside
        return f"<{tag}{name}>{inside}</{tag}>"

    def talk() -> str:
        """Readers' comments, each an article of its own, under a heading that alone tells what they are."""
        tag = rng.choice(("section", "div", "section"))
        level = rng.choice(("h2", "h3", "h4"))
        name = named("comments") if rng.random() < 0.3 else ""
        title = rng.choice(_TALK).format(n=rng.randint(1, 40)).capitalize()
        own = rng.choice(("article", "article", "div", "li"))
        said = [f"<{own}>{rng.choice(('<b>', '<header>', ''))}{_prose(rng, 1, 3)}<p>{_prose(rng, 2, 40)}</p></{own}>" for _ in range(rng.randint(1, 5))]
        inside = "".join(said)
        return f"<{tag}{name}><{level}>{title}</{level}>{f'<ul>{inside}</ul>' if own == 'li' else inside}</{tag}>"

    body, longest = [], rng.choice((90, 90, 90, 90, 6))
    if rng.random() < 0.8:
        body.append(f"<h1>{mark(_prose(rng, 1, 16))}</h1>")
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.65:
            text = _prose(rng, 1, longest)
            if rng.random() < 0.15:
                text = f"<b>{text}"
            if rng.random() < 0.1:
                text += f' <a href="#">{_prose(rng, 1, 3)}</a>'
            body.append(f"<p>{mark(text)}" + ("</p>" if rng.random() < 0.8 else "<br>"))
        elif kind < 0.75:
            body.append(f"<h2>{mark(_prose(rng, 1, 6))}</h2>")
        elif kind < 0.81:
            body.append("<ul>" + "".join(f"<li>{mark(_prose(rng, 1, 20))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.86:
            links = [f'<li><a href="#">{mark(_prose(rng, 1, 8))}</a></li>' for _ in range(rng.randint(1, 5))]
            body.append(f"<ul>{''.join(links)}</ul>")
        elif kind < 0.89:
            body.append(f"<blockquote><p>{mark(_prose(rng, 3, 30))}</p></blockquote>")
        elif kind < 0.92:
            body.append("<table><tr>" + "".join(f"<td>{mark(_prose(rng, 1, 3))}</td>" for _ in range(3)) + "</tr></table>")
        else:
            body.append(aside(rng.choice(("advert", "social", "sidebar", "notice"))))
        if rng.random() < 0.04:
            body.append("<button>" + _prose(rng, 1, 2) + "</button>")
    if rng.random() < 0.2:
        body.append(aside("comments") if rng.random() < 0.5 else talk())
    core = "".join(body)
    tag = rng.choice(("article", "article", "main", "div", "section"))
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else f' class="{" ".join(rng.sample(_BODY_NAMES, rng.randint(1, 2)))}"'
    core = f"<{tag}{name}>{core}</{tag}>"
    if rng.random() < 0.4:
        core = f"<main>{core}</main>" if tag != "main" else f'<div class="wrapper container">{core}</div>'
    before = [aside(k) for k in ("header", "menu", "advert", "notice", "form") if rng.random() < 0.6]
    after = [aside(k) for k in ("comments", "sidebar", "advert", "social", "footer", "notice") if rng.random() < 0.6]
    if rng.random() < 0.3:
        after.insert(0, talk())
    nodes = parse(f"<html><body>{''.join(before)}{core}{''.join(after)}</body></html>")
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if node.tag == "#text":
            node.truth = int("\x02" in node.text[0])
        if node.truth:
            nodes[node.parent].truth = 1
    return nodes


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 7) -> list[list[Node]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    nodes = parse(page)
    probability, _ = marginals(nodes, weights)
    return "\n\n".join(n.text[0] for n, p in zip(nodes, probability, strict=True) if n.tag == "#text" and p >= 0.5 and n.text[0])


def _extract(model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return extract


def extract_content(df: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    ship_package(df.sparkSession)
    pages = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    model = df.sparkSession.sparkContext.broadcast(weights if weights is not None else train(labelled_pages()))
    return pages.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
