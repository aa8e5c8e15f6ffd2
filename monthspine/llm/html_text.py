"""Main text of web pages: boosted trees over DOM nodes, and a decoding that respects the tree.

A page is read into a tree of nodes. Features of a node are its tag and attribute tokens by kind, the text, link and tag
density of its subtree, its depth and place, and how it compares with its siblings. Gradient-boosted trees give each node
the odds of being main text. They are trained here, on pages of the input: nodes that the markup itself names (article or
main, menus, footers, adverts and so on) are labelled by it. Each is used twice: with its names and the shape of another
node, so that names count by themselves, and with its shape and no names, for parts and pages that name nothing.

Decoding chooses for every node whether it is kept, with the largest sum of log odds such that nothing is kept below a
dropped node: from the leaves up, a child is kept if its own odds and the best choice below it are worth it together.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches

#: Most pages that train the trees.
TRAINING_PAGES = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: What may begin behind the last '>' and goes on to the end of the page.
_UNENDED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"[\s\x00]+")

# Element kinds of the HTML standard.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript iframe svg template noframes xmp math".split())
_NEVER = _RAW | set("head form button select option input label object canvas audio video dialog datalist".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
_SIDE_TAGS = set("nav header footer aside menu".split())
_MAIN_TAGS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id and role that name what is not, or what is, main text.
_SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu "
    "breadcrumb breadcrumbs header masthead topbar footer foot copyright sidebar aside rail widget related recommended more "
    "comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social toolbar pager pagination tags search form complementary "
    "contentinfo navigation".split()
)
_MAIN_NAMES = set("article main content body post entry story text prose page maincontent".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: tuple[str, ...] = ()
    children: list[int] = field(default_factory=list)
    #: (order, text) of the text directly inside.
    texts: list[tuple[int, str]] = field(default_factory=list)


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    values = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(_PART.findall(_CAMEL.sub(" ", values).lower()))


def parse(page: str | None) -> list[Node]:
    """Nodes in document order; node 0 stands for the page. Open elements end where the standard lets them end."""
    nodes = [Node("#page", -1, 0)]
    page = page or ""
    open_, at, order, end = [0], 0, 0, len(page)
    # behind the last '>' no tag ends, so none is looked for
    last = page.rfind(">")

    def text(raw: str) -> None:
        nonlocal order
        if raw:
            nodes[open_[-1]].texts.append((order, raw))
            order += 1

    while at < end:
        m = (_TOKEN if at <= last else _UNENDED).search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m.re is _UNENDED:
            break
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            for k in range(len(open_) - 1, 0, -1):
                here = nodes[open_[k]].tag
                if here == tag:
                    del open_[k:]
                    break
                # an inline end tag does not close blocks
                if tag not in _BLOCK and here in _BLOCK:
                    break
            continue
        if tag in _ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                here = nodes[open_[k]].tag
                if here == "p":
                    del open_[k:]
                    break
                if here in _BLOCK:
                    break
        if tag in _ENDS:
            for k in range(len(open_) - 1, 0, -1):
                here = nodes[open_[k]].tag
                if here in _ENDS[tag]:
                    del open_[k:]
                    if tag != "tr" or here == "tr":
                        break
                elif here in _SCOPE:
                    break
        parent = open_[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, _names(rest)))
        me = len(nodes) - 1
        nodes[parent].children.append(me)
        nodes[me].texts.append((order, ""))
        order += 1
        if tag in ("br", "wbr", "img", "hr"):
            text(" " if tag != "wbr" else "")
        if tag in _RAW and not rest.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            at = close.end() if close.end() > at or close[0] else end
        elif tag not in _VOID and not (rest.rstrip().endswith("/") and tag not in _BLOCK):
            open_.append(me)
    return nodes


FEATURES = (
    "side_tag main_tag side_name main_name in_main in_side p_tag heading list_item division table_cell inline depth n_children place_among_siblings "
    "n_siblings same_tag_siblings chars own_chars link_density words_per_tag chars_per_tag marks_per_word share_of_page begins_at "
    "sibling_chars chars_to_sibling_mean sibling_link_density parent_link_density parent_chars link_share_of_tags depth_share"
).split()
#: Features that stem from names, hidden in the second copy of a training node.
_NAMED = 6
_MARK = re.compile(r"[.,;:!?]")


def features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES for each node."""
    n = len(nodes)
    own, links, tags, words, marks, link_tags = (np.zeros(n) for _ in range(6))
    begin = np.zeros(n)
    linked, hidden = np.zeros(n, bool), np.zeros(n, bool)
    parent = np.array([max(0, x.parent) for x in nodes])
    seen = 0.0
    for i, x in enumerate(nodes):
        linked[i] = x.tag == "a" or linked[parent[i]]
        hidden[i] = x.tag in _NEVER or (i > 0 and hidden[parent[i]])
        begin[i] = seen
        if not hidden[i]:
            for _, t in x.texts:
                stripped = t.strip()
                if stripped:
                    own[i] += len(stripped)
                    words[i] += stripped.count(" ") + 1
                    marks[i] += len(_MARK.findall(stripped))
            seen += own[i]
    tags[:] = 1
    link_tags[:] = [x.tag == "a" for x in nodes]
    links[:] = own * linked
    chars = own.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, tags, words, marks, link_tags):
            a[p] += a[i]
    density = links / np.maximum(chars, 1)
    depth = np.array([x.depth for x in nodes], float)
    out = np.zeros((n, len(FEATURES)), np.float32)
    total = max(chars[0], 1)
    for i, x in enumerate(nodes):
        near = nodes[parent[i]].children if i else [0]
        others = len(near) - 1
        side_tag, main_tag = x.tag in _SIDE_TAGS, x.tag in _MAIN_TAGS
        side_name, main_name = any(a in _SIDE_NAMES for a in x.names), any(a in _MAIN_NAMES for a in x.names)
        out[i, :17] = (
            side_tag,
            main_tag,
            side_name,
            main_name,
            main_tag or (main_name and not side_name) or out[parent[i], 4],
            (side_tag or side_name or out[parent[i], 5]) and x.tag not in ("html", "body"),
            x.tag == "p",
            x.tag in _HEADINGS,
            x.tag in ("li", "ul", "ol"),
            x.tag in ("div", "section"),
            x.tag in ("td", "th", "tr"),
            x.tag not in _BLOCK,
            x.depth,
            len(x.children),
            0.0,
            others,
            0.0,
        )
    # sibling statistics once for each parent
    for i, x in enumerate(nodes):
        if x.children:
            kids = np.array(x.children)
            kinds = [nodes[k].tag for k in x.children]
            alike = Counter(kinds)
            k = len(kids)
            out[kids, 14] = np.arange(k) / k
            out[kids, 16] = [alike[t] / k for t in kinds]
            rest = (chars[kids].sum() - chars[kids]) / max(1, k - 1)
            out[kids, 25] = np.log1p(rest)
            out[kids, 26] = np.log1p(chars[kids]) - np.log1p(rest)
            out[kids, 27] = (density[kids].sum() - density[kids]) / max(1, k - 1)
    out[:, 17] = np.log1p(chars)
    out[:, 18] = np.log1p(own)
    out[:, 19] = density
    out[:, 20] = words / tags
    out[:, 21] = np.log1p(chars / tags)
    out[:, 22] = marks / np.maximum(words, 1)
    out[:, 23] = chars / total
    out[:, 24] = begin / total
    out[:, 28] = density[parent]
    out[:, 29] = np.log1p(chars[parent])
    out[:, 30] = link_tags / tags
    out[:, 31] = depth / max(depth.max(), 1)
    return out


def named_labels(nodes: list[Node]) -> np.ndarray:
    """1 main text, 0 not, -1 unknown, by what the markup says. A side name inside an article counts, and holds below."""
    side, main = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    holds_main = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        p = max(0, x.parent)
        own_side = x.tag in _SIDE_TAGS or any(a in _SIDE_NAMES for a in x.names)
        own_main = x.tag in _MAIN_TAGS or (x.tag in ("div", "section", "td") and any(a in _MAIN_NAMES for a in x.names))
        main[i] = main[p] or (own_main and not own_side)
        side[i] = (side[p] and i > 0) or (own_side and x.tag not in ("body", "html"))
    for i in range(len(nodes) - 1, 0, -1):
        holds_main[nodes[i].parent] |= holds_main[i] or (main[i] and not side[i])
    out = np.full(len(nodes), -1)
    out[main | holds_main] = 1
    out[side] = 0
    return out


# --- boosted trees --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Logistic gradient boosting with second-order leaf values over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    odds, n_inner = np.full(len(x), base), 2**depth - 1
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf, np.float32)
        for node in range(n_inner):
            here = np.flatnonzero(at == node)
            best = (1e-6, None)
            if len(here) >= 2:
                gh, hh = g[here], h[here]
                parent = gh.sum() ** 2 / (hh.sum() + 1)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[here, j]
                    gl = np.cumsum(np.bincount(b, gh, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hh, len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gh.sum() - gl) ** 2 / (hh.sum() - hl + 1) - parent
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1]:
                j, k = best[1]
                feature[node], threshold[node] = j, edges[j][k]
                at[here] = 2 * node + 1 + (binned[here, j] > k)
            else:
                at[here] = 2 * node + 1
        leaf = at - n_inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        odds += value[leaf]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(base, np.stack(all_f), np.stack(all_t), np.stack(all_v))


def fit_trees(pages: list[str | None]) -> Trees:
    """Trees from pages that name their parts; where none names its main text, paragraphs outside named sides stand for it."""
    xs, ys = [np.empty((0, len(FEATURES)), np.float32)], [np.empty(0)]
    for page in pages:
        nodes = parse(page)
        y, x = named_labels(nodes), features(nodes)
        xs.append(x)
        ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    if not (y == 1).any():
        y = np.where((y != 0) & (x[:, FEATURES.index("p_tag")] > 0), 1, y)
    x, y = x[y >= 0], y[y >= 0]
    if not len(y):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    hidden, named = x.copy(), x.copy()
    hidden[:, :_NAMED] = 0
    named[:, _NAMED:] = x[np.random.default_rng(3).permutation(len(x)), _NAMED:]
    balance = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    weight = np.concatenate([balance, 0.3 * balance])
    return boost(np.concatenate([named, hidden]), np.concatenate([y, y]).astype(float), weight * len(weight) / weight.sum())


def decode(nodes: list[Node], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are kept, and whose own text is: the best choice without a kept node below a dropped one.

    Inline elements without a name go with what they stand in. The page, html and body are kept to hold their parts; their
    own text needs odds in its favour. Elements that never show text are dropped.
    """
    n = len(nodes)
    own = np.array([sum(len(t.strip()) for _, t in x.texts) for x in nodes], float)
    never = np.array([x.tag in _NEVER for x in nodes])
    follows = np.array([x.tag not in _BLOCK and not x.names and x.parent >= 0 for x in nodes]) & ~never
    outer = np.array([x.tag in ("#page", "html", "body") for x in nodes])
    for i in range(n - 1, 0, -1):
        if follows[i]:
            own[nodes[i].parent] += own[i]
    # containers without text of their own say little; a paragraph counts with its length
    gain = np.where(follows, 0.0, odds * np.where(own > 0, 1 + np.log1p(own), 0.25))
    gain[never] = -np.inf
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    keep = np.ones(n, bool)
    for i in range(1, n):
        keep[i] = keep[nodes[i].parent] and not never[i] and bool(follows[i] or outer[i] or gain[i] > 0)
    return keep, keep & ~(outer & (odds <= 0))


def blocks(nodes: list[Node], keep: np.ndarray, shown: np.ndarray) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space single, trimmed, empty ones left out."""
    pieces = []
    holder = [0] * len(nodes)
    for i, x in enumerate(nodes):
        holder[i] = i if x.tag in _BLOCK or i == 0 else holder[x.parent]
        if keep[i]:
            pieces += [(order, holder[i], t if shown[i] else "") for order, t in x.texts]
        elif x.tag in _BLOCK and keep[max(0, x.parent)]:
            pieces.append((x.texts[0][0], -1, ""))  # a dropped block still parts the text around it
    out, current, last = [], [], None
    for _, h, t in sorted(pieces):
        if h != last and current:
            out.append("".join(current))
            current = []
        last = h
        current.append(t)
    out.append("".join(current))
    clean = (_WHITE.sub(" ", html.unescape(t)).strip() for t in out)
    return [t for t in clean if t]


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    odds = trees.odds(np.concatenate([features(n) for n in parsed])) if parsed else np.empty(0)
    ends = np.cumsum([len(n) for n in parsed])
    return ["\n\n".join(blocks(n, *decode(n, odds[e - len(n) : e]))) for n, e in zip(parsed, ends.tolist())]


def main_text(pages: DataFrame, trees: Trees, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, the columns ``keep``, ``text`` (empty if there is none) and ``n_chars`` (its code points).

    Null and empty pages have an empty text. Repeated rows and equal ids give a row each. Other columns are not read. An
    empty table gives no row.
    """

    def make():
        def step(ids, html_texts, *rest):
            texts = []
            for i in range(0, len(html_texts), 100):
                texts += extract(html_texts[i : i + 100], trees)
            return {"id": ids, "text": texts, "n_chars": [len(t) for t in texts]} | {f"k{k}": r for k, r in enumerate(rest)}

        return step

    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]
    )
    kinds = dict(pages.dtypes)
    carried = "".join(f", k{k} {'long' if kinds[c] == 'bigint' else kinds[c]}" for k, c in enumerate(keep))
    out = map_batches(rows, rows.columns, make, f"id long{carried}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "text", "n_chars")


def fit_pages(pages: DataFrame, rows: int = TRAINING_PAGES, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Trees from about ``rows`` pages at most."""
    sample = bounded_sample(pages.select(id_col, html_col), rows, F.col(id_col), F.col(html_col)).collect()
    return fit_trees([r[1] for r in sorted(sample, key=str)])


def op1_main_text(pages: DataFrame) -> DataFrame:
    return main_text(pages, fit_pages(pages), keep=("url",)).select("page_id", "url", "text", "n_chars")
