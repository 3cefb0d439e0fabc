"""Main text of web pages by tag-path ratios.

Each run of text in a page lies at the end of a path of open elements.  Per
path the text length and the punctuation are summed and divided by the number
of runs that the path has; the two ratios are spread over the page in reading
order, smoothed with a Gaussian and fused by the root of their product.  Blocks
with text on a path over the threshold are content, and short blocks between
content blocks of their container are filled in.  <article> and <main>, or else
the innermost container with most of the score, are a hint: text in them needs
less.  Boilerplate elements are left out before.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import map_rows, text_of

#: Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset(
    "head script style noscript template iframe noframes noembed nav header footer aside form button select textarea "
    "input option menu dialog svg math canvas audio video object map".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
BOUNDS = frozenset("html body article main section div ul ol dl table td th blockquote aside nav header footer form".split())
BOXES = BOUNDS - frozenset("ul ol dl table td th".split())
ARTICLE = frozenset(("article", "main"))
#: Elements whose class words say how the page is laid out, not what they are.
UNNAMED = ARTICLE | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a page may be wrapped in, or that often stay unclosed behind the article: left out unless they hold most of it.
WRAPS = frozenset(("form", "footer"))
#: Elements that end without an end tag, so that a missing one says nothing.
OPTIONAL = frozenset("body html p li dt dd tr td th tbody thead tfoot option optgroup".split())
#: Words of class, id and role names that mark what is no article.
NOTICES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo "
    "cookie cookies disqus footer header menu menubar modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion related reply replies share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget complementary banner search alert".split())
#: Words that such names join to them; any other word makes a name of its own (no-sidebar, related-work).
LAYOUT = frozenset(
    "area article articles bar block bottom box button buttons container desktop entry form global inner item items left "
    "link links list main mobile outer page post posts primary right secondary section signup site slot stories sub top unit wrap "
    "wrapper".split())
TITLED = frozenset("article entry page post".split())  # their header holds the article's own title

OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
TAG_STOPS = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?，。；：！？、¿¡]")
SIGMA = 1.0
#: Share of the page's mean score of a character that content reaches.
THRESHOLD = 0.75
#: What of the threshold is left inside the hint.
HINT = 1 / 3
#: Characters of one run that count, so that one giant run sets no page's scale.
CAP = 1000


def hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attributes)


def marks(attributes: list[tuple[str, str]]) -> bool:
    """Do the names of an element call it something else than an article?"""
    for name, value in attributes:
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = {x for x in SPLIT.split(word) if x and not x[0].isdigit()}
                if not parts.isdisjoint(NOTICES) and parts <= NOTICES | LAYOUT and not ("header" in parts and parts & TITLED):
                    return True
    return False


class Node:
    """An open or closed element; ``never`` (its element or attributes leave
    it out) and ``marked`` (left out unless it holds most of the page) are
    its own; ``ended``: by an end tag of its own.  ``path`` is the number of
    its path of names; ``order`` counts elements as they open and ``last`` is
    that of the last one inside."""

    __slots__ = ("name", "parent", "path", "never", "marked", "ended", "order", "last", "depth", "heading", "article", "box", "out", "hinted")

    def __init__(self, name: str, parent: Node | None, order: int, path: int, never: bool = False, marked: bool = False):
        self.name, self.parent, self.order, self.path, self.never, self.marked = name, parent, order, path, never, marked
        self.ended = name in OPTIONAL
        self.last = order
        self.depth = parent.depth + 1 if parent else 0
        self.heading = name in HEADINGS or parent is not None and parent.heading
        self.article = name in ARTICLE or parent is not None and parent.article
        self.box: Node = self if name in BOXES or parent is None else parent.box
        self.out = self.hinted = False

    def holds(self, other: Node) -> bool:
        return self.order <= other.order <= self.last


class Tags:
    """The tags of a page one after another, in time that grows with the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``at``
        (none in quotes does), or -1.  From each < that a search without
        success has passed outside quotes there is none either."""
        page, passed = self.page, []
        while at <= self.last:
            m = TAG_STOPS.search(page, at)
            if m is None:
                break
            c, at = m.group(), m.end()
            if c == ">":
                return m.start()
            if c == "<":
                if m.start() in self.dead:
                    break
                passed.append(m.start())
                continue
            close = page.find(c, at)
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag, comment or
        declaration (no name) from ``at`` on."""
        page = self.page
        while (m := OPENS.search(page, at)) is not None:
            start, at = m.start(), m.end()
            if m[2] is not None:
                stop = -1 if start in self.dead else self.end(at)
                if stop >= 0:
                    return start, stop + 1, m[1], m[2].lower(), page[at:stop]
            elif page.startswith("<!--", start):
                stop = page.find("-->", at)
                return start, stop + 3 if stop >= 0 else len(page), "", "", ""
            elif at <= self.last:
                return start, page.find(">", at) + 1, "", "", ""
            at = start + 1
        return None


def runs(page: str) -> tuple[list[tuple[Node, int, str]], list[Node]]:
    """(element, block number, raw text) of every run of text in page order,
    and all elements in the order in which they open."""
    root = Node("html", None, 0, 0)
    stack, nodes, out, block, at = [root], [root], [], 0, 0
    paths: dict[tuple[int, str], int] = {}
    places = defaultdict(list)  # of each name's open elements in the stack
    places["html"].append(0)

    def text(s: str) -> None:
        if s:
            out.append((stack[-1], block, s))

    def highest(names: frozenset | set) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    def close(names: frozenset | set, until: frozenset) -> None:
        k = highest(names)
        if k > 0 and k >= highest(until):
            stack[k].ended = True
            for x in stack[k:]:
                places[x.name].pop()
            del stack[k:]

    tags = Tags(page)
    while True:
        tag = tags.next(at)
        if tag is None:
            text(page[at:])
            for n in reversed(nodes[1:]):
                n.parent.last = max(n.parent.last, n.last)
            return out, nodes
        start, end, slash, name, attributes = tag
        text(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            if places[name] and places[name][-1] > 0:
                if name in BLOCK:
                    block += 1
                    close({name}, frozenset())
                else:
                    close({name}, BOUNDS)
            elif name in BLOCK:
                block += 1
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", ends.end()) if ends else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if name == "br":
            text("\n")
            continue
        if name in BLOCK:
            block += 1
        if name in ("html", "body") and places[name]:
            continue
        if name in CLOSES_P:
            close({"p"}, BOUNDS)
        if name in ALIKE:
            close(ALIKE[name], frozenset(("ul", "ol", "dl", "table", "select")))
        if name not in VOID and not attributes.endswith("/"):
            up = stack[-1]
            never = name in NEVER - WRAPS and not (name == "header" and up.name in ARTICLE)
            marked = name in WRAPS
            if attributes and name not in UNNAMED:
                own = [(x.lower(), v.strip("\"'").lower()) for x, v in ATTRIBUTE.findall(attributes)]
                never, marked = never or hidden(own), marked or marks(own)
            places[name].append(len(stack))
            stack.append(Node(name, up, len(nodes), paths.setdefault((up.path, name), len(paths) + 1), never, marked))
            nodes.append(stack[-1])


def kept(found: list[tuple[Node, int, str]], nodes: list[Node]) -> list[tuple[Node, int, str]]:
    """The runs outside boilerplate.  An element without its end tag bounds
    nothing and leaves nothing out, a footer excepted.  A marked element that
    holds most of the page's text and most of its score is no boilerplate,
    unless an <article> or <main> with text is free of marks."""
    for n in nodes:
        n.out = n.never and n.ended or n.parent is not None and n.parent.out
    alive = [x for x in found if not x[0].out]
    used = within({n for n, _, _ in alive}, nodes)
    marked = {n for n in used if n.marked and (n.ended or n.name == "footer")}
    if marked:
        below = under(marked, nodes)
        full = [(n, b, s.strip()) for n, b, s in found if s.strip()]
        if not any(n.article and n not in below and not n.out for n, _, _ in full):
            large = marked & most(full, [len(s) for _, _, s in full], 0.5, nodes)
            if large:
                fused, sizes, _ = scores(full)
                marked -= large & most(full, [a * b for a, b in zip(fused, sizes)], 0.5, nodes)
        below = under(marked, nodes)
        alive = [x for x in alive if x[0] not in below]
    return alive


def within(some: set[Node], nodes: list[Node]) -> set[Node]:
    """The elements that hold one of ``some``, these included."""
    out = set(some)
    for n in reversed(nodes):
        if n in out and n.parent is not None:
            out.add(n.parent)
    return out


def under(some: set[Node], nodes: list[Node]) -> set[Node]:
    """The elements inside one of ``some``, these included."""
    out: set[Node] = set()
    for n in nodes:
        if n in some or n.parent in out:
            out.add(n)
    return out


def most(full: list[tuple[Node, int, str]], weights: list[float], part: float, nodes: list[Node]) -> set[Node]:
    """The elements that hold at least this part of the weights."""
    held = defaultdict(float)
    for (n, _, _), w in zip(full, weights):
        held[n] += w
    for n in reversed(nodes):
        if n in held and n.parent is not None:
            held[n.parent] += held[n]
    least = part * sum(weights) * (1 - 1e-9)  # sums of the same values may differ in their last bits
    return {x for x, w in held.items() if w >= least}


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbours in page order."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[lo - i + reach:hi - i + reach]
        out.append(sum(a * b for a, b in zip(values[lo:hi], part)) / sum(part))
    return out


def scores(full: list[tuple[Node, int, str]]) -> tuple[list[float], list[int], dict[int, float]]:
    """Fused ratio and counted length of every run, mean fused ratio of every path."""
    length, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, _, s in full:
        length[node.path] += min(len(s), CAP)
        points[node.path] += min(len(PUNCTUATION.findall(s)), CAP // 20)
        count[node.path] += 1
    by_text = smooth([length[n.path] / count[n.path] for n, _, _ in full])
    by_points = smooth([(1 + points[n.path]) / count[n.path] for n, _, _ in full])
    fused = [math.sqrt(a * b) for a, b in zip(by_text, by_points)]
    sizes = [min(len(s), CAP) for _, _, s in full]
    score = defaultdict(float)
    for (n, _, _), x in zip(full, fused):
        score[n.path] += x / count[n.path]
    return fused, sizes, score


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The content blocks, joined by an empty line; "" if there are none.

    A block is content if a path of its text scores ``threshold`` times the
    page's mean score of a character, or HINT of that inside the hint.  Other
    blocks come in as `fill` says.
    """
    raw, nodes = runs(page)
    found = kept([(n, b, html.unescape(s)) for n, b, s in raw], nodes)
    full = [(n, b, s.strip()) for n, b, s in found if s.strip()]
    if not full:
        return ""
    fused, sizes, score = scores(full)
    least = threshold * sum(a * b for a, b in zip(fused, sizes)) / sum(sizes)
    hint = hints(full, [a * b for a, b in zip(fused, sizes)], nodes)
    for n in nodes:
        n.hinted = n in hint or n.parent is not None and n.parent.hinted
    # mean scores of equal values may differ in their last bits
    floor = (1 - 1e-9) * least
    pieces: dict[int, list[str]] = {}
    place: dict[int, Node] = {}
    chosen = set()
    for node, b, s in found:
        pieces.setdefault(b, []).append(s)
        if s.strip():
            place.setdefault(b, node)
            if score[node.path] >= floor * (HINT if node.hinted else 1.0):
                chosen.add(b)
    texts = {b: " ".join("".join(x).split()) for b, x in pieces.items() if b in place}
    return "\n\n".join(texts[b] for b in fill(texts, place, chosen))


def hints(full: list[tuple[Node, int, str]], weights: list[float], nodes: list[Node]) -> set[Node]:
    """The <article> and <main> elements with text, or else the innermost
    container with most of the weight."""
    named = {x for x in within({n for n, _, _ in full}, nodes) if x.name in ARTICLE}
    if named:
        return named
    boxes = [x for x in most(full, weights, 0.7, nodes) if x.name in BOXES]
    return {max(boxes, key=lambda x: x.depth)} if boxes else set()


def fill(texts: dict[int, str], place: dict[int, Node], chosen: set[int]) -> list[int]:
    """The chosen blocks and those that belong to them, in page order: blocks
    in the container of the chosen block before or behind them that are no
    longer than one of the two.  Before the first and behind the last chosen
    block of a container that holds for headings and inside the hint only; headings may be
    of any length."""
    order = list(texts)
    before, behind, last = {}, {}, None
    for b in order:
        before[b] = last
        last = b if b in chosen else last
    last = None
    for b in reversed(order):
        behind[b] = last
        last = b if b in chosen else last
    out = []
    for b in order:
        if b not in chosen:
            here = place[b]
            heading = here.heading
            ends = [x for x in (before[b], behind[b]) if x is not None]
            near = [x for x in ends if (place[x].box if place[x].box.name in BOXES else place[x]).holds(here)]
            inner = len(ends) == 2 or here.hinted
            if not near or not (heading and behind[b] in near or inner and (heading or len(texts[b]) <= max(len(texts[x]) for x in ends))):
                continue
        out.append(b)
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``id_col``, ``url_col`` and ``text``, the page's main text.

    A NULL, empty or textless page gives the empty text; NULL ids and urls
    stay; repeated rows give a row each; other columns take no part; an empty
    table gives no rows.  A page of any length or depth is handled whole, in
    time that grows with it.  Rows are handled where they are read, without a
    shuffle.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=[id_col, url_col, "text"])

    return map_rows(rows, run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, `{url_col}` string, text string")
