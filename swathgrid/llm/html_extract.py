"""Main text of web pages by wrapper induction.

Pages of one host are dealt into groups of a bounded size. In a group the pages' DOM trees are aligned
by simple tree matching, one after another, into one tree of what they share; what a page has beside it
is added to that tree. Nodes whose text stays the same from page to page are template; what varies is a
slot. The innermost node that holds all slots outside menus, headers, footers, adverts, forms and the like is
where the host keeps its articles, and each page's text is read from its own node there, less the template.

A page alone in its group has no neighbours to compare with: all its text counts as varying then.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Pages that are aligned with each other.
GROUP = 32
#: A node is template if one text is on at least this share of the different pages that have it.
CONSTANT = 0.8

#: Hosts of which a list is broadcast (about 50 bytes each).
BROADCAST = 200_000
#: What is nested deeper hangs on the element at this depth; its text stays in place.
DEEPEST = 150
#: Lists of children whose sizes multiply to more are paired in order by label, without looking for the best pairing.
WIDEST = 250_000

# ---- a small tree builder

#: Fixed names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"))
#: What a start tag closes, and the elements that this doesn't reach beyond.
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_LIMITS = frozenset("article aside body button div footer form header li main nav section table td th ul ol dl".split())
_REPEATED = frozenset("p li tr dt dd".split())
_WAY = frozenset("html body div section article main center table tbody tr td".split())
_MENUS = frozenset("div section ul ol table p".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A comment, a declaration, or the beginning of a tag up to its attributes.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_CUE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|sponsor(?:ed)?|promos?|promotions?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|site-?header|page-?header|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|alerts?|newsletters?|subscribe|subscription|social|share|sharing|related|recommended|comments?|disqus|respond|replies|popup|modal|overlay|login|signup|widgets?|toolbar|pagination|pager|search|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: A slash at the end of a tag that isn't the end of a value without quotes.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
#: Of boxes of readers' words.
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies)(?:$|[\s_-])", re.IGNORECASE)
#: What is beside the article by its tag or role: always, or unless it is the bulk of the page.
_ALWAYS_OFF, _OFF_TAGS = frozenset("nav aside footer".split()), frozenset("form button dialog menu fieldset".split())
_ALWAYS_OFF_ROLES = re.compile(r"(?:^|\s)(?:navigation|contentinfo|complementary)(?:\s|$)", re.IGNORECASE)
_OFF_ROLES = re.compile(r"(?:^|\s)(?:banner|search|dialog|alert|menu)(?:\s|$)", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "label", "off", "cue", "talk", "parts", "seen", "texts", "kids", "own", "shape", "mass", "menu", "offs")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.parts = tag, []  # parts: child nodes and strings in page order
        self.kids, self.own, self.seen, self.texts, self.mass = None, "", 0, None, 0.0
        # off: left out; cue, talk: left out unless it is the bulk of the page
        name, self.off, self.cue, self.talk, self.menu = "", tag in _ALWAYS_OFF, tag in _OFF_TAGS, False, False
        for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            value, key = values[0] or values[1] or values[2], key.lower()
            if key in ("class", "id"):
                name = name or re.sub(r"\d+", "0", value.strip().split(" ")[0].lower())
                # a page often tells on its body or article which boxes it has: only inner boxes are cues
                if tag not in ("html", "body", "article", "main"):
                    self.cue |= bool(_CUE.search(value))
                    self.talk |= bool(_TALK.search(value))
            elif key == "role":
                self.off |= bool(_ALWAYS_OFF_ROLES.search(value))
                self.cue |= bool(_OFF_ROLES.search(value))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                self.talk = True
        self.label = f"{tag}.{name}"


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose attributes begin at `at` ends: at the next `>` outside quotes, or the next at all if there is none.

    dead: opening quotes from which no end is found, so that broken quotes are followed to the end of the page only once.
    """
    place, opened = at, []
    while (m := _QUOTE_OR_END.search(page, place)) and m.start() not in dead:
        if m[0] == ">":
            return m.start()
        opened.append(m.start())
        place = page.find(m[0], m.end()) + 1
        if not place:
            break
    dead.update(opened)
    return page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree. Scripts, styles, titles and other raw elements are left out; open tags end where they must.

    What follows the last `>` is text. The time is in proportion to the page, however broken it is.
    """
    root = Node("html")
    stack, at = [root], 0
    dead, endless, last = set(), set(), page.rfind(">")
    while True:
        m = _MARK.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at, tag, attributes = m.end(), (m[2] or "").lower(), ""
        if not tag:
            continue
        if at > last:
            stack[-1].parts.append(page[m.start() :])
            return root
        end = _tag_end(page, at, dead)
        attributes, at = page[at:end], end + 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _LIMITS and tag not in _LIMITS:  # a stray inline end tag
                    break
            continue
        if tag in _RAW:
            # in the page itself: a lowered copy is longer where it holds a dotted capital I
            close = None if tag in endless else re.compile(f"</{tag}", re.IGNORECASE | re.ASCII).search(page, at)
            if close:
                at = page.find(">", close.start()) + 1 or len(page)
            else:
                endless.add(tag)
                at = len(page) if tag in ("script", "style") else at
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                node = Node(tag, attributes)
                stack[0].parts.append(node)
                stack = [stack[0], node]
            continue
        closes, limits = _CLOSES.get(tag, ("p", _LIMITS) if tag in _ENDS_P else (None, ()))
        for _ in range(2 if closes and tag in _ENDS_P and closes != "p" else 1):
            for k in range(len(stack) - 1, 0, -1):
                if closes and stack[k].tag in closes.split(" "):
                    del stack[k:]
                    break
                if not closes or stack[k].tag in limits:
                    break
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        if tag not in _VOID and not _CLOSED.search(attributes) and len(stack) < DEEPEST:
            stack.append(node)


def _inner(n: Node) -> list[Node]:
    return [p for p in n.parts if not isinstance(p, str) and not p.off]


def _prose(root: Node) -> dict[int, tuple[int, int, int]]:
    """For each node that is not off its text outside links, of that the text outside headings, and of that the text of articles and main parts."""
    order: list[tuple[Node, int, bool, bool]] = [(root, -1, False, False)]
    sums = []
    for n, _, head, part in order:  # grows while it is read: the node after its parent
        head, part, link = head or n.tag in _HEADS, part or n.tag in ("article", "main"), n.tag in ("a", "button")
        own, up = 0, len(sums)
        for p in n.parts if not link else ():
            if isinstance(p, str):
                own += 0 if p.isspace() else len(p) - p.count(" ")
            elif not p.off:
                order.append((p, up, head, part))
        sums.append([own, 0 if head else own, own if part and not head else 0])
    for (_, up, _, _), own in zip(reversed(order[1:]), reversed(sums[1:]), strict=True):
        above = sums[up]
        above[0] += own[0]
        above[1] += own[1]
        above[2] += own[2]
    return {id(n): tuple(x) for (n, *_), x in zip(order, sums, strict=True)}


def _drop(root: Node, prose: dict[int, tuple[int, int, int]], talk: bool) -> None:
    """Set boxes off that are beside the article by a cue (or as readers' words or hidden), but never the bulk of a page.

    The bulk is a box with half of the page's text outside links, unless an article or main part elsewhere has text of its
    own (around the box: a twentieth of the page); readers' words and hidden boxes go, too, if the rest has a twentieth outside headings.
    """
    total, body, part = prose[id(root)]
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        own = prose.get(id(n), (0, 0, 0))
        if n.talk if talk else n.cue and not n.talk:
            bulk = own[0] > 0 and 2 * own[0] >= total and (part - own[2]) * 20 < (total if inside else 1)
            if not bulk or talk and (body - own[1]) * 20 >= total:
                n.off = True
                continue
        todo += [(p, inside or n.tag in ("article", "main")) for p in _inner(n)]


def _weigh_cues(root: Node) -> None:
    """Settle which boxes are off: readers' words and hidden boxes first, then the others, of the text that is left.

    If less than a twentieth of the text is left then, and no article, boxes by class or id stay after all. A header that is the bulk of a page is no header.
    Boxes whose text is links, two at least, are marked as menus: these don't count where the slot is looked for, but
    stay if they lie inside it.
    """
    order = [root]
    for n in order:
        order += _inner(n)
    prose = _prose(root)
    if any(n.talk for n in order):
        _drop(root, prose, True)
        prose = _prose(root)
    before = prose[id(root)][1]
    if any(n.cue for n in order):
        _drop(root, prose, False)
        prose = _prose(root)
        if 20 * prose[id(root)][1] < before and not prose[id(root)][2]:
            for n in order:
                n.off &= not n.cue or n.talk or n.tag in _OFF_TAGS or n.tag in _ALWAYS_OFF
            prose = _prose(root)
    total, _, part = prose[id(root)]
    for n in order:
        own = prose.get(id(n), (0, 0, 0))
        if n.tag == "header" and own[1] > 0 and 2 * own[0] >= total and part == own[2]:
            n.tag = "section"
    mass, linked = {}, {}
    for n in reversed(order):
        if n.off:
            continue
        inner = _inner(n)
        mass[id(n)] = sum(len(p) - p.count(" ") for p in n.parts if isinstance(p, str) and not p.isspace()) + sum(mass[id(p)] for p in inner)
        own = [(mass[id(n)], 1)] if n.tag == "a" else [linked[id(p)] for p in inner]
        linked[id(n)] = (sum(x for x, _ in own), sum(x for _, x in own))
        n.menu = n.tag in _MENUS and linked[id(n)][1] > 1 and 5 * linked[id(n)][0] >= 4 * mass[id(n)]


def _settle(node: Node) -> None:
    """Set kids (child nodes, with runs of like paragraphs, items or rows as one) and own (text beside them)."""
    todo = [node]
    while todo:
        n = todo.pop()
        kids, own, last = [], [], None
        runs: dict[int, list[str]] = {}
        for p in n.parts:
            if isinstance(p, str):
                if not p.isspace():
                    own.append(p)
                    last = None
            elif p.tag not in _BLOCK:
                own.append(_flat(p))
            elif last is not None and p.label == last and p.tag in _REPEATED:
                runs[len(kids) - 1].append(_flat(p))
                continue
            else:
                last = p.label if p.tag in _REPEATED else None
                kids.append(p)
                if last:
                    p.kids, runs[len(kids) - 1] = [], [_flat(p)]
                else:
                    todo.append(p)
        for k, texts in runs.items():
            kids[k].own = "\n".join(texts)
        n.kids, n.own = kids, " ".join(" ".join(own).split())


def _flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.off:
            todo += reversed(n.parts)
    return " ".join("".join(out).split())


# ---- alignment


def _in_order(one: list[Node], two: list[Node]) -> Iterator[tuple[Node, Node]]:
    """Each node of the first list with the next node of the second that has its label, if there is one."""
    places: dict[str, list[int]] = {}
    for j, n in enumerate(two):
        places.setdefault(n.label, []).append(j)
    at = -1
    for n in one:
        own = places.get(n.label, [])
        k = bisect.bisect_right(own, at)
        if k < len(own):
            at = own[k]
            yield n, two[at]


def _shape(node: Node) -> int:
    """Set shape on every node of the tree: equal for trees of the same labels."""
    node.shape = hash((node.label, tuple(map(_shape, node.kids))))
    return node.shape


def matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of nodes of the same label, in order, under pairs; with the pairs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return 1, [(a, b)]
    # trees of one shape match whole, and children of different labels only where they agree: no pairing is better
    if m * n > WIDEST or a.shape == b.shape or [k.label for k in a.kids] == [k.label for k in b.kids] and len({k.label for k in a.kids}) == m:
        found = [matching(x, y) for x, y in _in_order(a.kids, b.kids)]
        return 1 + sum(f[0] for f in found), [(a, b), *(p for f in found for p in f[1])]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    held: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w, pairs = matching(a.kids[i - 1], b.kids[j - 1])
            if w:
                held[i, j] = (w, pairs)
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    out, i, j = [(a, b)], m, n
    while i and j:
        if (i, j) in held and best[i][j] == best[i - 1][j - 1] + held[i, j][0]:
            out += held[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], out


def _copy(node: Node) -> Node:
    out = Node(node.tag)
    out.label, out.off, out.menu, out.seen, out.texts, out.offs = node.label, node.off, node.menu, 0, {}, 0
    out.kids = [_copy(k) for k in node.kids]
    return out


def induce(pages: list[Node], different: list[bool]) -> tuple[Node, list[dict[int, Node]]]:
    """The aligned tree of the pages, and for each page its nodes by the id of the tree's node.

    Only pages marked as different count: a copy of a page says nothing about what stays the same.
    """
    tree, maps = _copy(pages[0]), []
    for page, counts in zip(pages, different, strict=True):
        _shape(tree)
        _shape(page)
        pairs = matching(tree, page)[1]
        at = {id(t): p for t, p in pairs}
        back = {id(p): t for t, p in pairs}
        for t, p in pairs:
            after, last = {None: []}, None
            for k in p.kids:  # what the tree lacks is added after the last matched neighbour
                if id(k) in back:
                    last = id(back[id(k)])
                    continue
                new = _copy(k)
                after.setdefault(last, []).append(new)
                todo = [(new, k)]
                while todo:
                    x, y = todo.pop()
                    at[id(x)] = y
                    todo += zip(x.kids, y.kids, strict=True)
            if len(after) > 1 or after[None]:
                t.kids = [*after[None], *(y for x in t.kids for y in (x, *after.get(id(x), ())))]
        if counts:
            size, todo = 0, [page]
            while todo:
                t = todo.pop()
                size += len(t.own)
                todo += t.kids
            todo = [tree]
            while todo:
                t = todo.pop()
                if id(t) in at:
                    t.seen += 1
                    t.offs += at[id(t)].off
                    t.mass += len(at[id(t)].own) / max(1, size)
                    t.texts[at[id(t)].own] = t.texts.get(at[id(t)].own, 0) + 1
                    todo += t.kids
        maps.append(at)
    todo = [tree]
    while todo:  # what most pages keep, all keep: a page with a short article has the same boxes
        t = todo.pop()
        t.off = 2 * t.offs > t.seen
        todo += t.kids
        if t.offs and not t.off and t.seen >= 3:
            for at in maps:
                if id(t) in at:
                    at[id(t)].off = False
    return tree, maps


def constant(t: Node) -> bool:
    """The node's own text stays the same over at least three different pages."""
    return t.seen >= 3 and max(t.texts.values()) >= CONSTANT * t.seen


def _varying(tree: Node) -> dict[int, float]:
    """Varying text under each node, as shares of the pages' text, so that each page counts alike. Boxes beside the article have none."""
    order, out = [(tree, False)], {}
    for t, inside in order:
        inside = inside or t.tag in ("article", "main")
        if not (t.off or t.menu or t.tag == "header" and not inside):
            order += [(k, inside) for k in t.kids]
            out[id(t)] = 0.0 if constant(t) else t.mass
    for t, _ in reversed(order):
        if id(t) in out:
            out[id(t)] += sum(out.get(id(k), 0.0) for k in t.kids)
    return out


def slot(tree: Node) -> Node:
    """The innermost node of the aligned tree that holds all varying text."""
    at, mass = tree, _varying(tree)
    while True:
        inner = [k for k in at.kids if k.tag in _WAY]
        own, total = [mass.get(id(k), 0.0) for k in inner], mass.get(id(at), 0.0)
        if not inner or not total or max(own) < total * (1 - 1e-9) or at.tag == "article":  # a sibling varies too
            return at
        at = inner[int(np.argmax(own))]


# ---- text of a page


def blocks(node: Node, left_out: set[int] = frozenset()) -> list[str]:
    """The blocks of text under a node, in page order."""
    out, line = [], []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    article = node.tag in ("article", "main")
    todo: list[tuple] = [("node", node, article)]
    while todo:
        kind, n, inside = todo.pop()
        if kind == "text":
            line.append(n)
        elif kind == "end":
            end()
        elif n is not node and (n.off or id(n) in left_out):
            continue
        elif n.tag == "br":
            line.append(" ")
        elif n.tag == "header" and n is not node and not inside:
            continue
        else:
            inside = inside or n.tag in ("article", "main")
            parts = n.parts
            if n.tag == "header" and n is not node:
                parts = [p for p in parts if not isinstance(p, str) and p.tag in _HEADS]
            if n.tag in _BLOCK:
                end()
                todo.append(("end", None, inside))
            todo += [("text", p, inside) if isinstance(p, str) else ("node", p, inside) for p in reversed(parts)]
    end()
    return out


def _without_cues(page: Node) -> Node:
    """The page, of whose boxes only those are off that their tag or role says so."""
    todo = [page]
    while todo:
        n = todo.pop()
        n.off &= not n.cue and not n.talk or n.tag in _OFF_TAGS or n.tag in _ALWAYS_OFF
        todo += [p for p in n.parts if not isinstance(p, str)]
    return page


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each page of a host, by the wrapper of all of them. Null and empty pages give an empty text."""
    trees = []
    for page in pages:
        tree = parse(page or "")
        _weigh_cues(tree)
        _settle(tree)
        trees.append(tree)
    known: set[int] = set()
    different = [not (hash(p) in known or known.add(hash(p))) for p in pages]
    tree, maps = induce(trees, different)
    place = slot(tree)
    out = []
    for page, at in zip(trees, maps, strict=True):
        own = at.get(id(place))
        left_out = set()
        if own is not None and place.tag not in ("article", "main"):
            todo = list(place.kids)
            while todo:  # template inside the slot; an article's own paragraphs always stay
                t = todo.pop()
                if id(t) in at and not t.kids and t.texts and constant(t) and any(t.texts) and t.tag not in _HEADS:
                    left_out.add(id(at[id(t)]))
                todo += t.kids
        text = blocks(own, left_out) if own is not None else []
        if not text:  # this page keeps its text elsewhere: read it by itself
            alone, (mine,) = induce([page], [True])
            text = blocks(mine[id(slot(alone))])
        if not text:  # or in boxes that seemed to be beside the article
            text = blocks(_without_cues(page))
        out.append("\n".join(text))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(id, url, text, n_chars) for every page, from its whole HTML.

    Pages without a host in their url (or without url) are a host of their own kind. Null HTML gives an
    empty text. Hosts with many pages are dealt into groups of about `group` by their hashed rows, so
    no host is ever in one task, with ids or without. Repeated rows stay repeated, repeated and null ids are ids like others.
    An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))
    large = pages.select(host.alias("_large")).groupBy("_large").count().where(F.col("count") > group)
    large = cut(large.select("_large", F.ceil(F.col("count") / group).cast("int").alias("_groups")))
    # counted first: a short list is broadcast, so that the pages are shuffled once; a longer one is joined by a shuffle
    large = F.broadcast(large) if large.count() <= BROADCAST else large
    met = rows.join(large, F.col("_host") == F.col("_large"), "left")
    # the page is hashed, too, so that rows without an id don't fall together
    dealt = met.withColumn("_group", F.coalesce(F.pmod(F.xxhash64("_id", "_url", "_html"), F.col("_groups")), F.lit(0)).cast("int"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.select("_host", "_group", "_id", "_url", "_html").repartition(n, "_host", "_group").sortWithinPartitions("_host", "_group", "_id")
    schema = T.StructType(
        [T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            texts = extract([h for _, _, h in held])
            columns = [pa.array([x[0] for x in held], kind), pa.array([x[1] for x in held], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(2).type
            for host, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != (host, part) or len(held) >= 4 * group):
                    yield done()
                    held = []
                key = (host, part)
                held.append(row)
        if held:
            yield done()

    return ready.mapInArrow(run, schema)
