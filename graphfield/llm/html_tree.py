"""HTML extraction by a tree-structured graphical model.

A page is parsed to its tree of block elements; inline ones only add to their
block.  Each node is content or not.  Its features (tag, words of class and id,
text length, share of link text, sentence ends) give a unary potential, each
parent-child pair a pair potential by what the parent is and whether the child
holds text.  Sum-product messages go up and down the tree once and give exact
marginals; text of nodes with a content marginal above a half is kept, one piece
for each stretch between block boundaries.

Weights are fitted by gradient ascent of the exact conditional likelihood on
labelled pages.  ``labelled_pages`` makes them from a seed: its blocks carry their
label in an attribute that no feature reads.  Other labelled pages in that form may
be given instead.

Script, style, textarea, title, xmp, iframe and noframes hold raw text up to their end
tag, which is never content, nor is text in head, noscript, template, svg, button or
select.  Those are elements like others: unclosed, they end with their parent, and
button, select and svg at the next block as well; head ends at what can't stand in it.

A null or empty html has an empty text.  A page of any length or depth is parsed in one
pass: open tags are counted, and what a start tag closes is looked up, not searched.  A
marginal of exactly a half (a tie) isn't content.  Repeated rows are extracted each.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, ready

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style iframe textarea title noframes xmp".split())
#: Text in these isn't content; the second lot ends at the next block.
BRIEF = frozenset("button select svg".split())
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
SKIP = frozenset("head noscript template".split()) | BRIEF
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article main section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption address details summary dialog menu center hgroup search legend".split())
#: What a start tag closes, if it is open in the nearest of the tags that bound it.
CELLS = "td th table body html"
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "tbody": ("thead tbody tfoot", "table"), "body": ("head", ""), "p": ("p", CELLS)}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SAME = {"dd": "dt", "th": "td", "thead": "tbody", "tfoot": "tbody"}
#: The entries of CLOSES in which a tag plays a part.
PARTS = {t: [k for k, (a, b) in CLOSES.items() if t in a | b] for t in frozenset().union(*(a | b for a, b in CLOSES.values()))}
CLUES = frozenset("nav navbar menu sidebar side footer header head ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert comment comments reply replies discussion share social related recommended newsletter subscribe signup login search form breadcrumb breadcrumbs widget popup modal masthead topbar copyright legal disclaimer byline meta tags author pagination article content post entry main story body text page wrapper container".split())
CLUE = re.compile(r"[a-z]+")
ENDS = re.compile(r"[.!?…][\"'”»)]*(?:\s|$)")


class Node:
    __slots__ = ("clues", "depth", "index", "label", "length", "links", "parent", "sentences", "tag")

    def __init__(self, tag: str, parent: int, index: int, depth: int, clues: frozenset, label: int | None):
        self.tag, self.parent, self.index, self.depth, self.clues, self.label = tag, parent, index, depth, clues, label
        self.length = self.links = self.sentences = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in document order, and the pieces of text with the node each belongs to."""
    nodes = [Node("html", -1, 0, 0, frozenset(), None)]
    pieces: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, and the nearest block node of each
    count = Counter()  # open elements by tag
    marks: dict[str, list[tuple[int, bool]]] = {k: [] for k in CLOSES}  # for each entry of CLOSES its open tags, and whether they are closed by it
    buffer: list[str] = []
    linked, at, in_link, hidden = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            if text := " ".join(_html.unescape("".join(buffer)).split()):
                node = nodes[stack[-1][1]]
                node.length += len(text)
                node.links += min(linked, len(text))
                node.sentences += len(ENDS.findall(text))
                pieces.append((node.index, text))
            buffer.clear()
        linked = 0

    def push(tag: str, node: int) -> None:
        nonlocal in_link, hidden
        stack.append((tag, node))
        count[tag] += 1
        for k in PARTS.get(tag, ()):
            marks[k].append((len(stack) - 1, tag in CLOSES[k][0]))
        in_link += tag == "a"
        hidden += tag in SKIP

    def cut(to: int) -> None:
        """Close all from that place of the stack on."""
        nonlocal in_link, hidden
        while len(stack) > to:
            if stack[-1][0] in BLOCK:
                flush()
            tag, _ = stack.pop()
            count[tag] -= 1
            for k in PARTS.get(tag, ()):
                marks[k].pop()
            in_link -= tag == "a"
            hidden -= tag in SKIP

    def place(tag: str) -> int:
        at = len(stack) - 1
        while stack[at][0] != tag:
            at -= 1
        return at

    def closes(entry: str) -> None:
        if marks[entry] and marks[entry][-1][1]:
            cut(marks[entry][-1][0])

    def words(text: str) -> None:
        nonlocal linked
        if text and count["head"] and not count["noscript"] and not count["template"] and not text.isspace():
            cut(place("head"))
        if text and not hidden:
            buffer.append(text)
            if in_link:
                linked += len(text)

    while True:
        m = TOKEN.search(page, at)
        words(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                words(_html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if count[tag]:
                cut(place(tag))
            continue
        if count["head"] and tag not in IN_HEAD and not count["noscript"] and not count["template"]:
            cut(place("head"))
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words(" ")
            continue
        if tag == "html" or (tag == "svg" and m[3].endswith("/")):
            continue
        if tag in BLOCK:
            for brief in BRIEF:
                if count[brief]:
                    cut(place(brief))
            closes("p")
        if (entry := SAME.get(tag, tag)) in CLOSES and entry != "p":
            closes(entry)
        if tag in BLOCK:
            flush()
            attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3] else {}
            clues = frozenset(CLUE.findall(" ".join(v for k, v in attributes.items() if k in ("class", "id", "role", "aria-label")).lower())) & CLUES if attributes else frozenset()
            if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
                clues |= {"hidden"}
            label = attributes.get("data-y")
            nodes.append(Node(tag, stack[-1][1], len(nodes), len(stack), clues, int(label) if label else None))
            push(tag, len(nodes) - 1)
        else:
            push(tag, stack[-1][1])
    flush()
    return nodes, pieces


def features(node: Node) -> list[str]:
    n = node.length
    size = "none" if not n else "short" if n < 25 else "line" if n < 80 else "some" if n < 250 else "long"
    out = ["bias", "tag " + node.tag, "size " + size, *("clue " + c for c in node.clues)]
    if n:
        out.append("links " + ("most" if 2 * node.links > n else "some" if node.links else "no"))
        out.append("sentences " + ("no" if not node.sentences else "one" if node.sentences == 1 else "more"))
        if node.tag in ("div", "section", "body", "td"):
            out.append(f"bare {size}")
    return out


def pair(parent: Node, child: Node) -> str:
    kind = "root" if parent.tag in ("html", "body") else "group"
    return f"{kind} {'leaf' if child.length else 'inner'}"


class TreeField:
    """Weights of features for being content, and log-potentials (parent, child) of each kind of pair."""

    def __init__(self, unary: dict[str, float] | None = None, pairs: dict[str, list[float]] | None = None):
        self.unary, self.pairs = unary or {}, pairs or {}

    def potentials(self, nodes: list[Node]) -> tuple[list[float], list[list[float]]]:
        get = self.unary.get
        return [exp(max(-40.0, min(40.0, sum(get(f, 0.0) for f in features(n))))) for n in nodes], [[exp(x) for x in self.pairs.get(pair(nodes[n.parent], n), (0, 0, 0, 0))] if n.parent >= 0 else [] for n in nodes]

    def marginals(self, nodes: list[Node], with_pairs: bool = False) -> tuple[list[float], list[list[float]]]:
        """P(content) of each node, and of each pair with its parent the four joint probabilities.  Nodes come after their parents."""
        odds, links = self.potentials(nodes)
        up0, up1 = [1.0] * len(nodes), list(odds)  # own potential and what the children say
        said0, said1 = [1.0] * len(nodes), [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b = up0[i], up1[i]
            a, b = a / (a + b), b / (a + b)
            up0[i], up1[i] = a, b
            l00, l01, l10, l11 = links[i]
            m0, m1 = l00 * a + l01 * b, l10 * a + l11 * b
            m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
            said0[i], said1[i] = m0, m1
            p = nodes[i].parent
            x, y = up0[p] * m0, up1[p] * m1
            up0[p], up1[p] = x / (x + y), y / (x + y)
        belief = [0.0] * len(nodes)
        joint: list[list[float]] = [[]] * len(nodes)
        belief[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, len(nodes)):
            b1 = belief[nodes[i].parent]
            d0, d1 = (1 - b1) / max(said0[i], 1e-300), b1 / max(said1[i], 1e-300)
            l00, l01, l10, l11 = links[i]
            j = [d0 * l00 * up0[i], d0 * l01 * up1[i], d1 * l10 * up0[i], d1 * l11 * up1[i]]
            total = sum(j)
            belief[i] = (j[1] + j[3]) / total
            if with_pairs:
                joint[i] = [x / total for x in j]
        return belief, joint


def learn(pages: list[str], rounds: int = 60, rate: float = 1.0, decay: float = 2e-3) -> TreeField:
    """Gradient ascent (adaptive steps) of the likelihood of the labels; a node without one has its parent's."""
    trees = []
    for page in pages:
        nodes, _ = parse(page)
        for n in nodes:
            n.label = n.label if n.label is not None else nodes[n.parent].label if n.parent >= 0 else 0
        trees.append((nodes, [features(n) for n in nodes], [pair(nodes[n.parent], n) if n.parent >= 0 else "" for n in nodes]))
    field, seen_u, seen_p = TreeField(), Counter(), Counter()
    for _ in range(rounds):
        gu, gp = Counter(), {}
        for nodes, fs, ps in trees:
            belief, joint = field.marginals(nodes, True)
            for n, b, f, p, j in zip(nodes, belief, fs, ps, joint, strict=True):
                slip = n.label - b
                for x in f:
                    gu[x] += slip
                if p:
                    g = gp.setdefault(p, [0.0] * 4)
                    for k in range(4):
                        g[k] += (k == 2 * nodes[n.parent].label + n.label) - j[k]
        for x, g in gu.items():
            g = g / len(trees) - decay * field.unary.get(x, 0.0)
            seen_u[x] += g * g
            field.unary[x] = field.unary.get(x, 0.0) + rate * g / (seen_u[x] ** 0.5 + 1e-3)
        for p, gs in gp.items():
            now = field.pairs.setdefault(p, [0.0] * 4)
            for k, g in enumerate(gs):
                g = g / len(trees) - decay * now[k]
                seen_p[p, k] += g * g
                now[k] += rate * g / (seen_p[p, k] ** 0.5 + 1e-3)
    return field


def labelled_pages(count: int = 160, seed: int = 5) -> list[str]:
    """Pages of varied make-up: where the article stands, how its parts are marked, and what surrounds it."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwyp"

    def words(n: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(r.randint(1, 16)).capitalize() + r.choice("....?!") for _ in range(n))

    def tag(name: str, inner: str, y: int, attributes: str = "") -> str:
        return f'<{name} data-y="{y}"{attributes}>{inner}</{name}>'

    def links(n: int, y: int = 0) -> str:
        return "<ul data-y=\"0\">" + "".join(tag("li", f'<a href="/{words(1)}">{words(r.randint(1, 3))}</a>', y) for _ in range(n)) + "</ul>"

    def cls(*names: str) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def clutter() -> list[str]:
        kinds = [
            lambda: tag("nav", links(r.randint(2, 8)), 0), lambda: tag("div", links(r.randint(3, 8)), 0, cls("menu", "nav", "navbar", "main-menu")), lambda: tag("nav", "".join(f"<a href=/>{words(1)}</a> " for _ in range(5)), 0),
            lambda: tag("header", r.choice(["", tag("div", words(3), 0)]) + r.choice([links(3), tag("p", words(4), 0)]), 0), lambda: tag("div", words(r.randint(1, 4)), 0, cls("header", "masthead", "topbar")),
            lambda: tag("div", sentences(r.randint(1, 4)), 0, cls("ad", "ads", "advert", "banner", "promo", "sponsored")), lambda: tag("div", tag("p", sentences(r.randint(1, 4)), 0), 0, cls("ad", "advert", "promo", "sponsor")),
            lambda: tag("aside", r.choice([links(4), tag("p", sentences(r.randint(1, 4)), 0), tag("h3", words(2), 0) + links(3), sentences(2)]), 0), lambda: tag("div", tag("h3", words(2), 0) + r.choice([links(5), tag("p", sentences(2), 0)]), 0, cls("sidebar", "related", "widget", "recommended")),
            lambda: tag("div", r.choice([sentences(2), tag("p", sentences(r.randint(1, 3)), 0)]) + "<button>ok</button>", 0, cls("cookie", "cookie-notice", "consent", "notice", "popup", "alert")), lambda: tag("section", tag("p", sentences(r.randint(1, 3)), 0), 0, cls("notice", "newsletter", "cookie-banner")),
            lambda: tag("form", tag("label", words(2), 0) + "<input name=q>" + tag("p", sentences(1), 0), 0), lambda: tag("form", sentences(1) + "<input type=text><button>go</button>", 0, cls("search", "subscribe", "login")),
        ]
        return [r.choice(kinds)() for _ in range(r.randint(1, 5))]

    def comments() -> str:
        one = lambda: tag(r.choice(["div", "li", "article"]), r.choice([tag("p", sentences(r.randint(1, 6)), 0), sentences(2)]), 0, cls("comment", "reply") if r.random() < 0.8 else "")
        return tag(r.choice(["section", "div", "ol"]), tag("h3", words(2), 0) * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 4))), 0, cls("comments", "comment-list", "discussion", "replies"))

    def bottom() -> list[str]:
        foot = [lambda: tag("footer", f"&copy; {words(2)} &middot; {sentences(1)}", 0), lambda: tag("footer", tag("p", sentences(r.randint(1, 3)), 0) + links(3), 0), lambda: tag("div", r.choice([words(5), tag("p", sentences(2), 0)]), 0, cls("footer", "copyright", "legal")), lambda: tag("footer", links(4), 0)]
        return [r.choice(foot)()]

    def paragraph() -> str:
        text = sentences(r.choice([1, 1, 2, 4, 8, 20]))
        if r.random() < 0.2:
            text = f'<b>{text}<br>'
        elif r.random() < 0.2:
            text += f' <a href="/x">{words(2)}</a> {sentences(1)}'
        return tag("p", text, 1)

    def part() -> str:
        return r.choice([paragraph] * 8 + [
            lambda: tag(r.choice(["h2", "h3", "h4"]), words(r.randint(1, 7)), 1), lambda: tag(r.choice(["ul", "ol"]), "".join(tag("li", r.choice([words(r.randint(1, 6)), sentences(2)]), 1) for _ in range(r.randint(2, 5))), 1),
            lambda: tag("blockquote", r.choice([sentences(2), tag("p", sentences(2), 1)]), 1), lambda: tag("pre", words(12), 1), lambda: tag("table", tag("tr", "".join(tag("td", words(r.randint(1, 3)), 1) for _ in range(3)), 1) * 3, 1), lambda: tag("figure", "<img src=a>" + tag("figcaption", words(6), 1), 1),
            lambda: tag("div", sentences(r.randint(1, 5)), 1), lambda: tag("section", tag("h2", words(3), 1) + paragraph() * 2, 1),
        ])()

    def page() -> str:
        parts = [tag("h1", words(r.randint(2, 10)), 1)] * (r.random() < 0.8) + [part() for _ in range(r.choice([1, 2, 4, 8, 16]))]
        if r.random() < 0.3:
            parts.insert(r.randint(1, len(parts)), r.choice(clutter()))
        if r.random() < 0.15:
            parts.append(comments())
        if r.random() < 0.15:
            parts.insert(0, tag("header", parts.pop(0), 1))
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            inner = tag("article", inner, 1, r.choice(["", "", cls("post", "article")]))
        elif kind < 0.65:
            inner = tag("main", inner, 1)
        elif kind < 0.9:
            inner = tag(r.choice(["div", "section"]), inner, 1, cls("content", "article", "post", "entry", "main-content", "story", "article-body") if r.random() < 0.8 else "")
        if r.random() < 0.3 and kind < 0.9:
            inner = tag(r.choice(["main", "div"]), inner + "".join(clutter()[:1]) * r.randint(0, 1), 1, r.choice(["", cls("wrapper", "container", "page")]))
        body = "".join(clutter()) + inner + (comments() if r.random() < 0.3 else "") + "".join(clutter()[:1]) * (r.random() < 0.4) + "".join(bottom()) * (r.random() < 0.8)
        return f'<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(4)}</title><style>p{{}}</style></head><body data-y="0">{body}</body></html>'

    return [page() for _ in range(count)]


def main_text(page: str | None, field: TreeField) -> str:
    nodes, pieces = parse(page or "")
    if not pieces:
        return ""
    belief, _ = field.marginals(nodes)
    return "\n\n".join(text for node, text in pieces if belief[node] > 0.5)


def extract(pages: DataFrame, field: TreeField | None = None) -> DataFrame:
    """page_id, url, the main text and its length, for each page."""
    sent = ready(pages.sparkSession).sparkContext.broadcast(field or learn(labelled_pages()))

    def make():
        def step(rows):
            texts = [main_text(p, sent.value) for p in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return per_batch(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), "page_id long, url string, text string, n_chars long", make)


def op10_html(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
