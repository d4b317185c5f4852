"""Main text of web pages by a tree-structured graphical model.

Every block element and every block of text of a page is a node with a hidden state, content or not. Node potentials come
from what a node looks like (tag, class and id words, length, links), edge potentials from how states pass from parents to
children. Sum-product messages run up the tree and down again, which gives each block of text its exact marginal; blocks
more likely content than not make up the text. All potentials are estimated by counting on labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Names of HTML elements.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend button select option".split())
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas textarea title".split())
CONTROLS = frozenset("form fieldset legend button select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind closes an open element of the second kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HOLDERS = frozenset("article aside div main section td th table ul ol dl body form header footer nav blockquote figure fieldset".split())
#: Of these, the ones that belong to running text.
INNER = frozenset("ul ol dl table td th blockquote figure".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math|head)\b(?:"[^"]*"|'[^']*'|[^<>"'])*>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"<]*"|'[^'<]*'|[^>"'<])*)>?|<[!?/][^<>]*>|(?P<text>[^<]+|<)""",
    re.S,
)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str  # "#text" for a block of text
    parent: int
    names: frozenset = frozenset()
    text: str = ""
    linked: int = 0
    label: int = 0
    children: list = field(default_factory=list)


def name_words(found: str) -> list[str]:
    """Words of class and id names. A word alone says more than one inside a longer name: ``comments`` against ``comments-free``."""
    out = []
    for name in found.split():
        words = re.findall(r"[a-z]+", name)
        out += words if len(words) == 1 else [*(f"{w}-" for w in words), "-".join(words)]
    return out


def parse(page: str) -> list[Node]:
    """The page's block elements and blocks of text; parents stand before children. Unclosed and stray tags are tolerated.

    Time is linear in the page: of each tag the places of its open elements are known, and a raw element that no end follows
    is not looked for twice.
    """
    nodes = [Node("#root", -1)]
    open_nodes, names = [0], ["#root"]
    places: dict[str, list[int]] = defaultdict(list)  # in the stack of open elements, by tag
    holders = [0]
    endless: set[str] = set()
    buffer: list[str] = []
    state = {"link": 0, "linked": 0, "space": False}

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            nodes[open_nodes[-1]].children.append(len(nodes))
            nodes.append(Node("#text", open_nodes[-1], text=text, linked=min(state["linked"], len(text))))
        buffer.clear()
        state["linked"] = 0

    def close(tag: str) -> None:
        if not places[tag]:
            return
        flush()
        while True:
            name = names.pop()
            open_nodes.pop()
            places[name].pop()
            if name in HOLDERS:
                holders.pop()
            if name == tag:
                return

    at = 0
    while (m := TOKEN.match(page, at)) is not None:
        at = m.end()
        if m["text"]:
            buffer.append(m["text"])
            state["linked"] += len(m["text"]) if state["link"] else 0
        elif m["raw"]:
            at = _behind(page, m["raw"].lower(), at, m.group().endswith("/>"), endless)
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag == "a":
                state["link"] = 0 if m["end"] else 1
            elif tag == "br":
                buffer.append(" ")
            elif tag in BLOCKS:
                if m["end"]:
                    close(tag)
                    continue
                flush()
                nearest = max(((places[t][-1], t) for t in CLOSES.get(tag, {"p"} if tag not in VOID else ()) if places[t]), default=(-1, ""))
                if nearest[0] >= holders[-1]:
                    close(nearest[1])
                if tag not in VOID:
                    found = " ".join(a or b or c for a, b, c in NAME.findall(m["attrs"] or "")).lower()
                    nodes[open_nodes[-1]].children.append(len(nodes))
                    nodes.append(Node(tag, open_nodes[-1], frozenset(name_words(found)), label=int("data-main" in (m["attrs"] or ""))))
                    places[tag].append(len(names))
                    if tag in HOLDERS:
                        holders.append(len(names))
                    open_nodes.append(len(nodes) - 1)
                    names.append(tag)
    flush()
    return nodes


#: What ends a script or style that is never closed: the next tag of a block.
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
#: Elements without markup inside; in the others an own closing slash ends the element.
PLAIN = frozenset("script style textarea title".split())


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>|(?=<body\b)" if tag == "head" else rf"</{tag}\b[^>]*>", re.I)


def _behind(page: str, tag: str, at: int, slash: bool, endless: set[str]) -> int:
    """Where the page goes on behind an element that is skipped and whose opening tag ends at ``at``; tags without an end go to ``endless``.

    An element that closes itself, or is never closed, ends with its tag; a script or style that is never closed goes up to the
    next tag of a block. So no element swallows the rest of the page.
    """
    if slash and tag not in PLAIN:
        return at
    end = None if tag in endless else _end_of(tag).search(page, at)
    if end is None:
        endless.add(tag)
    if end is None and tag in PLAIN and "" not in endless:
        end = BLOCK_TAG.search(page, at)
        if end is None:
            endless.add("")  # no block follows
        return end.start() if end else at
    return end.end() if end else at


def looks(n: Node) -> list[str]:
    """What a node shows of itself."""
    if n.tag != "#text":
        return [f"tag:{n.tag}", *(f"name:{x}" for x in sorted(n.names))]
    size, links = len(n.text), n.linked / len(n.text)
    return [f"size:{min(size.bit_length(), 9)}", f"links:{0 if links == 0 else 1 if links < 0.5 else 2}", f"stop:{n.text[-1] in '.!?…。'}"]


def kind(n: Node) -> str:
    """Blocks of text, elements that hold others, parts of forms and the rest (paragraphs, headings, items) take states from
    parents differently."""
    return "text" if n.tag == "#text" else "control" if n.tag in CONTROLS else "holder" if n.tag in HOLDERS - INNER else "block"


#: How much the looks of blocks count: those of one part of a page are alike, so each tells less than it would alone.
SHARE = {"block": 0.35, "text": 0.35}


@dataclass
class Model:
    node: dict[str, float]  # log odds of content that a look adds
    edge: dict[tuple[str, int], float]  # (kind of the child, state of the parent) -> probability that the child is content

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node, by one pass up and one down the tree."""
        odds = [exp(max(-30.0, min(30.0, SHARE.get(kind(n), 1.0) * sum(self.node.get(x, 0.0) for x in looks(n))))) for n in nodes]
        own = [[1.0, o] for o in odds]  # node potential times the messages of the children
        up = [[1.0, 1.0] for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            own_kind = kind(nodes[i])
            for s in (0, 1):
                p = self.edge[own_kind, s]
                up[i][s] = (1 - p) * own[i][0] + p * own[i][1]
            total = up[i][0] + up[i][1]
            up[i] = [x / total for x in up[i]]
            parent = own[nodes[i].parent]
            parent[0], parent[1] = parent[0] * up[i][0], parent[1] * up[i][1]
            total = parent[0] + parent[1]
            parent[0], parent[1] = parent[0] / total, parent[1] / total
        belief: list[list[float]] = [[1.0, 0.0]] + [[0.0, 0.0]] * (len(nodes) - 1)  # the root is no content
        for i in range(1, len(nodes)):
            own_kind, above = kind(nodes[i]), belief[nodes[i].parent]
            without = [above[s] / max(up[i][s], 1e-300) for s in (0, 1)]  # the parent without what this child told it
            b = [0.0, 0.0]
            for s in (0, 1):
                p = self.edge[own_kind, s]
                b[0] += without[s] * (1 - p)
                b[1] += without[s] * p
            b = [b[0] * own[i][0], b[1] * own[i][1]]
            total = b[0] + b[1]
            belief[i] = [x / total for x in b]
        return [b[1] for b in belief]

    def text(self, page: str | None, threshold: float = 0.5) -> str:
        nodes = parse(page or "")
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes)) if n.tag == "#text" and p >= threshold)


def fit(pages: list[str], smooth: float = 0.5) -> Model:
    """Potentials counted on labelled pages: elements that hold main text carry the attribute data-main, and so do their
    contents unless an element inside carries data-rest."""
    seen: dict[str, Counter] = defaultdict(Counter)
    total: dict[bool, Counter] = defaultdict(Counter)
    passed: dict[tuple[str, int], Counter] = defaultdict(Counter)
    for page in pages:
        nodes = parse(page)
        for n in nodes[1:]:
            if n.tag == "#text":
                n.label = nodes[n.parent].label
            text = n.tag == "#text"
            total[text][n.label] += 1
            passed[kind(n), nodes[n.parent].label][n.label] += 1
            for x in looks(n):
                seen[x][n.label] += 1
    node = {}
    for x, c in seen.items():
        t = total[x.startswith(("size", "links", "stop"))]
        node[x] = log((c[1] + smooth) / (t[1] + 2 * smooth)) - log((c[0] + smooth) / (t[0] + 2 * smooth))
    edge = {(k, s): (passed[k, s][1] + smooth) / (sum(passed[k, s].values()) + 2 * smooth) for k in ("text", "block", "holder", "control") for s in (0, 1)}
    return Model(node, edge)


# ---- labelled pages -------------------------------------------------------------------------------------------------

# How sites name the parts of a page.
MAIN = ['article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="article entry"', 'div class="story text"', 'article class="post"']
#: How articles name the containers inside. Names that merely contain the word of another part belong to the article.
INSIDE = ["div", "div", "div", "section", "section", 'div class="highlight"', 'div class="section"', 'div class="body"', 'div class="paragraph"', 'div class="row"', 'div class="table-wrapper"', 'div class="code"', 'section id="introduction"', 'div class="text"', "article"]
DECOYS = ["comments", "comment", "ad", "ads", "menu", "sidebar", "footer", "header", "form", "nav", "related", "share", "cookie", "newsletter", "promo", "banner"]
TURNED = ["{}-free zone", "no-{}", "has-{}", "with-{}", "{}-less", "without-{} text", "after-{}", "{}-off"]
#: Parts that readers and forms leave inside an article.
WITHIN = [
    ('section class="comments"', "comments"), ('div id="comments" class="comment-list"', "comments"), ('div class="reader-comments"', "comments"), ('ol class="commentlist"', "comments"), ("form", "controls"), ('form class="subscribe"', "controls"),
    ('div class="poll"', "controls"), ("button", "short"), ("select", "options"), ('div class="newsletter-form"', "controls"), ('div class="related-posts"', "links"), ("fieldset", "controls"), ("nav", "links"), ('aside class="note"', "mixed"), ("footer", "short"),
]
REST = [
    ("nav", "links"), ('nav class="menu"', "links"), ('ul class="menu navigation"', "links"), ('div class="breadcrumb"', "links"), ("header", "short"), ('div class="header top"', "short"), ("footer", "short"), ('div id="footer"', "short"),
    ("aside", "mixed"), ('div class="sidebar"', "mixed"), ('div class="related widget"', "links"), ('div class="ad"', "prose"), ('div class="ads banner sponsored"', "prose"), ('div class="advert promo"', "prose"), ('div class="cookie notice"', "prose"),
    ('div class="cookie-notice"', "prose"), ('div class="ad-banner"', "prose"), ('div class="site-footer"', "short"), ('div class="main-menu"', "links"), ('div class="sidebar-left"', "mixed"), ('div class="comments-area"', "comments"), ('div class="share-buttons"', "links"),
    ('div class="newsletter-signup"', "prose"), ('div class="promo-box"', "prose"), ('div class="header-top"', "short"), ('div class="nav-links"', "links"), ('div class="related-links"', "links"), ('div class="search-form"', "controls"),
    ('div class="newsletter subscribe popup"', "prose"), ("form", "short"), ('form class="search"', "short"), ('section class="comments"', "comments"), ('div id="comments" class="comment-list"', "comments"), ('div class="share social"', "links"), ('div class="legal copyright"', "short"),
]


def labelled_pages(n: int = 800, seed: int = 7) -> list[str]:
    """Training pages with known main text, made from page parts in many orders and with texts of any length.

    Each also shows what misleads: one-word paragraphs in the article, long prose in adverts and comments, advert and
    related boxes inside the article, unclosed paragraphs, main text in plain or named containers, code and figures.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrstlmdé") for _ in range(rng.randint(1, 9)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda: some(1, rng.choice([1, 2, 10, 40, 90])).capitalize() + rng.choice([".", ".", ".", "?", ""])

    def rest(part: tuple[str, str]) -> str:
        opening, kind = part
        tag = opening.split()[0]
        item = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
        inner = {
            "links": lambda: "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 9))) if rng.random() < 0.7 else " | ".join(item() for _ in range(4)),
            "short": lambda: rng.choice(["", "&copy; "]) + some(1, 8) + rng.choice(["", ".", f" <p>{some(2, 6)}</p>", item()]),
            "mixed": lambda: f"<h3>{some(1, 3)}</h3><p>{prose()}</p><ul>" + "".join(f"<li>{item()}</li>" for _ in range(3)) + "</ul>",
            "prose": lambda: rng.choice([prose(), f"<p>{prose()}</p>"]),
            "comments": lambda: rng.choice(["", f"<h3>{some(1, 2)}</h3>", f"<h2>{some(1, 2)}</h2>"]) + "".join(rng.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<div>{}</div>", '<li class="comment"><p>{}</p></li>', "<blockquote>{}</blockquote>"]).format(prose()) for _ in range(rng.randint(1, 5))),
            "controls": lambda: "".join(rng.choice([f"<label>{some(1, 3)}</label><input>", f"<button>{some(1, 3)}</button>", f"<select><option>{some(1, 2)}<option>{some(1, 2)}</select>", f"<p>{prose()}</p>", f"<legend>{some(1, 3)}</legend>"]) for _ in range(rng.randint(1, 4))),
            "options": lambda: "".join(f"<option>{some(1, 3)}</option>" for _ in range(rng.randint(1, 5))),
        }[kind]()
        if kind == "links" and not tag.startswith("ul") and "<li>" in inner:
            inner = f"<ul>{inner}</ul>"
        return f"<{opening}>{inner}</{tag}>"

    def marked(opening: str, inner: str) -> str:
        return f"<{opening} data-main>{inner}</{opening.split()[0]}>"

    def nested() -> str:
        """Main text inside containers of its own."""
        inside = [marked("p", prose()), marked("p", prose()), prose(), marked("h3", some(1, 5)), marked("pre", marked("code", some(1, 30))), marked("ul", marked("li", prose()) + marked("li", some(1, 5)))]
        inner = "".join(rng.choice(inside) for _ in range(rng.choice([1, 1, 2, 4])))
        for _ in range(rng.choice([1, 1, 2, 3])):
            inner = marked(rng.choice(INSIDE) if rng.random() < 0.75 else f'div class="{rng.choice(TURNED).format(rng.choice(DECOYS))}"', inner)
        return inner

    pages = []
    for _ in range(n):
        body = []
        for _ in range(rng.choice([1, 2, 5, 12])):
            kind = rng.random()
            if kind < 0.14:
                body.append(nested())
            elif kind < 0.7:
                body.append(f"<p data-main>{prose()}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.8:
                body.append(marked(f"h{rng.randint(2, 4)}", some(1, 6)))
            elif kind < 0.88:
                body.append("<ul data-main>" + "".join(marked("li", rng.choice([prose(), some(1, 4), f'<a href="/x">{some(1, 4)}</a>'])) for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                body.append(rng.choice([lambda: marked("blockquote", marked("p", prose())), lambda: marked("figure", marked("figcaption", some(2, 12))), lambda: marked("dl", marked("dt", some(1, 3)) + marked("dd", prose()))])())
            elif kind < 0.95:
                body.append(rest(rng.choice([p for p in REST if "ad" in p[0] or "related" in p[0] or "share" in p[0]])))
            elif kind < 0.985:
                body.append(rest(rng.choice(WITHIN)))
            else:
                body.append(marked("table", marked("tr", marked("td", some(1, 3)) + marked("td", some(1, 20)))))
        if rng.random() < 0.3:  # comments and forms stand at the end, if anywhere
            body += [rest(rng.choice(WITHIN)) for _ in range(rng.randint(1, 2))]
        head = marked("h1", some(2, 10)) if rng.random() < 0.8 else ""
        main = marked(rng.choice(MAIN), head + "".join(body))
        if rng.random() < 0.3:
            main = f'<div class="{rng.choice(["wrapper", "container", "page"])}">{main}</div>'
        above, below = ([rest(rng.choice(REST)) for _ in range(rng.randint(0, 3))] for _ in range(2))
        pages.append(f"<html><head><title>{some(1, 5)}</title></head><body>{''.join(above)}{main}{''.join(below)}</body></html>")
    return pages


@lru_cache(maxsize=2)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars (code points).

    Null html counts as empty. Rows are independent; repeated rows give equal results, an empty table an empty one. Pages of
    any length are parsed whole; columns other than id, url and html are not read, so their names cannot clash. A block as
    likely content as not counts as content.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shared.value.text(h) for h in b.column(2).to_pylist()], pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
