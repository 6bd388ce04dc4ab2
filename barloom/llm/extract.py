"""Main text of web pages: flat blocks classified by a small decision tree.

A page is read once into flat text blocks; a block ends at the start or end of
any element but phrasing ones, and at ``<br>``. Each block has its words, its
link density, the same of the blocks before and after it, and what its
surroundings say (three hints from element names and the names in class, id and
role). A decision tree, grown from the labelled pages below, says which blocks
are main text; those are joined by one space in page order.

Defined cases: a null html is the empty page; a page without main text gives an
empty text. Repeated rows give a row each; page_id and url are carried along,
null or not. Markup may be broken: unclosed elements end with their parents, a
stray ``<`` is text, an unclosed comment or script ends with the page. White
space is what Unicode calls so, no-break spaces included. The page is read in
one pass, so a very long one costs in proportion. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements that do not end a block, that have no end, whose content is not text.
PHRASING = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template title textarea iframe svg object audio video canvas select noframes".split())
#: Elements that a new one of the same set closes, within the nearest list, table or row.
SIBLINGS = [frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"tr"}), frozenset({"td", "th"}), frozenset({"option"})]
#: Main text is expected in these.
MAIN = frozenset("article main".split())
#: Menus, headers, footers, sidebars, forms.
ASIDE = frozenset("nav aside footer form header menu dialog button fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: First or last part of a name in class or id.
MAIN_NAMES = frozenset("article content main post entry story body text prose".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts adsense advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs skip "
    "header masthead topbar footer colophon copyright legal sidebar aside widget widgets related recommended recommendations trending popular share sharing social "
    "notice notices notification cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login search searchbox form comment comments reply replies respond disqus discussion".split())
#: A name that starts so says what a page has, not what an element is.
ABOUT = frozenset("with without has no not is".split())

TAG = re.compile(r"""<(?:!--|/?([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""")
LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[^a-z0-9]+")


@functools.lru_cache(maxsize=20_000)
def hint(name: str, attributes: str, inside: bool) -> int:
    """What an element says of its content: 1 main text, -1 something else, 0 nothing; ``inside`` main text a header is its heading."""
    asides = ASIDE_NAMES - {"header"} if inside else ASIDE_NAMES
    says = 1 if name in MAIN else -1 if name in ASIDE and not (inside and name == "header") else 0
    if name in ("html", "body") or not attributes:
        return says
    for key, *values in NAMES.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role":
            says = -1 if value in ASIDE_ROLES else 1 if value in ("main", "article") else says
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return -1
        elif key == "itemprop":
            says = 1 if value == "articlebody" else says
        elif key in ("class", "id"):
            for one in value.split():
                parts = [p for p in PARTS.split(one) if p]
                if not parts or parts[0] in ABOUT:
                    continue
                if parts[0] in asides or parts[-1] in asides:
                    says = -1
                elif says == 0 and (parts[0] in MAIN_NAMES or parts[-1] in MAIN_NAMES):
                    says = 1
    return says


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, linked words, in main, in aside) of each flat text block, in page order."""
    out: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, bool]] = []
    # open elements: name, and how many say main or aside so far
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    links, at, n = 0, 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join([t for t, _ in held])).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, inside in held if inside)
                out.append((text, linked, stack[-1][1], stack[-1][2]))
            held.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            held.append((page[at:lt], links > 0))
        if lt == n:
            break
        found = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if found is None:
            held.append(("<", links > 0))
            at = lt + 1
            continue
        at = found.end()
        if page.startswith("<!--", lt):
            end = COMMENT_END.search(page, lt + 2)  # <!--> is a whole comment
            at = end.end() if end else n
            continue
        if found.lastindex is None:  # doctype and such
            continue
        name, attributes = found.group(1).lower(), found.group(2)
        if page[lt + 1] == "/":
            if name == "a":
                links = 0
            if name in PHRASING:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in OPAQUE:
            if not attributes.endswith("/") or name != "svg":
                end = closing(name).search(page, at)
                at = end.end() if end else n
            if name not in ("script", "style", "template"):
                flush()
            continue
        if name == "a":
            links = 1
        if name in PHRASING:
            continue
        flush()
        if name in VOID:
            continue
        if stack[-1][0] == "p":  # no block stands inside a paragraph
            stack.pop()
        for kin in SIBLINGS:
            if name in kin and stack[-1][0] in kin:
                stack.pop()
        _, main, aside = stack[-1]
        says = hint(name, attributes, main > 0)
        stack.append((name, main + (says > 0), aside + (says < 0)))
    flush()
    return out


@functools.lru_cache(maxsize=64)
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "in_aside", "page_has_main")


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """A row a block, in the order of FEATURES."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    words = np.fromiter((t.count(" ") + 1 for t, *_ in found), float, n)
    density = np.fromiter((x[1] for x in found), float, n) / np.maximum(words, 1)
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6] = [x[2] > 0 for x in found]
    out[:, 7] = [x[3] > 0 for x in found]
    out[:, 8] = ((out[:, 6] > 0) & (out[:, 7] == 0)).any() if n else 0
    return out


# The labelled table: pages of invented words, each a list of (surroundings, words, words in links, 1 for main text).
LABELLED = [
    [("nav ul li", 1, 1, 0), ("nav ul li", 2, 2, 0), ("nav ul li", 1, 1, 0), ("div.ad", 12, 0, 0), ("article h1", 7, 0, 1), ("article p", 90, 0, 1), ("article p", 3, 0, 1), ("article p", 140, 2, 1), ("article p", 1, 0, 1), ("footer", 14, 0, 0)],
    [("header", 3, 1, 0), ("div.menu ul li", 2, 2, 0), ("div.menu ul li", 1, 1, 0), ("main h1", 9, 0, 1), ("main p", 55, 0, 1), ("main ul li", 4, 0, 1), ("main ul li", 6, 0, 1), ("aside", 30, 25, 0), ("aside p", 45, 0, 0), ("footer p", 60, 4, 0)],
    [("div.cookie-notice p", 40, 2, 0), ("div.topbar", 5, 5, 0), ("div.entry-content p", 70, 1, 1), ("div.entry-content blockquote", 22, 0, 1), ("div.entry-content p", 2, 0, 1), ("div.comments p", 35, 0, 0), ("div.comments p", 80, 0, 0), ("div.comments p", 2, 0, 0), ("form label", 4, 0, 0)],
    [("div", 4, 4, 0), ("div", 3, 3, 0), ("div", 80, 1, 1), ("div", 65, 0, 1), ("div", 12, 0, 1), ("div", 90, 3, 1), ("div", 6, 6, 0), ("div", 5, 5, 0), ("div", 4, 1, 0)],
    [("table tr td", 2, 2, 0), ("table tr td", 2, 2, 0), ("table tr td", 3, 2, 0), ("p", 45, 0, 1), ("p", 120, 4, 1), ("p", 30, 0, 1), ("p", 9, 9, 0), ("p", 7, 7, 0)],
    [("nav", 8, 8, 0), ("div.promo p", 50, 3, 0), ("article header h1", 8, 0, 1), ("article p", 12, 0, 1), ("article p", 200, 0, 1), ("article div.share", 3, 3, 0), ("article div.related li", 7, 7, 0), ("article figure figcaption", 11, 0, 1), ("article section.comments p", 66, 0, 0)],
    [("div.sidebar p", 90, 1, 0), ("div.sidebar li", 3, 3, 0), ("article p", 33, 0, 1), ("article pre", 40, 0, 1), ("article table tr td", 2, 0, 1), ("article p", 5, 5, 1), ("div.newsletter form p", 25, 0, 0), ("p", 70, 0, 0), ("footer", 9, 3, 0)],
    [("h1", 6, 0, 1), ("p", 60, 0, 1), ("p", 75, 2, 1), ("p", 18, 0, 1), ("p", 110, 0, 1), ("div.footer", 20, 2, 0), ("p", 3, 2, 0)],
    [("div#header", 5, 0, 0), ("div#content h2", 4, 0, 1), ("div#content p", 1, 0, 1), ("div#content p", 28, 0, 1), ("div#content p", 7, 7, 1), ("div#content div.advert", 18, 0, 0), ("div#content p", 64, 0, 1), ("div", 16, 0, 0), ("div#footer p", 30, 0, 0)],
    [("div.alert", 15, 1, 0), ("article h2", 5, 5, 1), ("article p", 2, 2, 1), ("article p", 41, 0, 1), ("form p", 9, 0, 0), ("div", 55, 0, 0), ("div", 8, 0, 0), ("footer ul li", 2, 2, 0)],
    [("p", 2, 0, 0), ("p", 3, 3, 0), ("p", 50, 1, 1), ("p", 14, 0, 1), ("p", 85, 0, 1), ("p", 5, 5, 0), ("p", 4, 4, 0), ("p", 2, 0, 0)],
    [("div", 1, 1, 0), ("div", 2, 2, 0), ("div", 9, 0, 1), ("div", 130, 2, 1), ("div", 44, 0, 1), ("div", 3, 3, 0), ("div", 2, 2, 0)],
]


def labelled_page(rows: list[tuple[str, int, int, int]]) -> str:
    """The HTML of one labelled page; a step of the surroundings is name, name.class or name#id."""
    out = []
    for steps, words, linked, _ in rows:
        opened = [re.match(r"(\w+)(?:([.#])(.+))?", s).groups() for s in steps.split()]
        tags = "".join(f"<{name}" + (f' {"class" if mark == "." else "id"}="{own}"' if mark else "") + ">" for name, mark, own in opened)
        text = f"<a href='/x'>{' '.join(['word'] * linked)}</a> " * (linked > 0) + " ".join(["word"] * (words - linked))
        out.append(f"{tags}{text}{''.join(f'</{name}>' for name, *_ in reversed(opened))}")
    return f"<html><body>{''.join(out)}</body></html>"


def labelled_rows(pages: list[list[tuple[str, int, int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table."""
    x, y = [], []
    for rows in LABELLED if pages is None else pages:
        found = blocks(labelled_page(rows))
        if len(found) != len(rows):
            raise ValueError("a labelled row is not one block")
        x.append(features(found))
        y += [r[3] for r in rows]
    return np.vstack(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above) or the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        impurity = np.where(ok, k * p * (1 - p) + (len(y) - k) * q * (1 - q), np.inf)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-12:
            best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, at = best
    low = x[:, f] <= at
    return f, at, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def main_text(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """Which rows the tree takes for main text."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree > 0.5)
    f, at, low, high = tree
    below = x[:, f] <= at
    out = np.empty(len(x), bool)
    out[below], out[~below] = main_text(low, x[below]), main_text(high, x[~below])
    return out


@functools.lru_cache(maxsize=1)
def trained() -> tuple | float:
    """The tree of the labelled table, grown once per worker."""
    return grow(*labelled_rows())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            found = [blocks(page or "") for page in batch.column("html").to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            kept = main_text(tree, np.vstack([features(x) for x in found])) if ends[-1] else np.zeros(0, bool)
            texts = [" ".join([b[0] for b, keep in zip(x, kept[i:j].tolist()) if keep]) for x, i, j in zip(found, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
