"""Main text of HTML pages by the distribution of text lengths over line blocks."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Lines of a sliding window, and the text lengths over a window at which the main text surges and dives.
WINDOW, SURGE, DIVE = 3, 120, 40
#: A line with more of its characters in links than this has no weight of its own.
LINKED = 0.5

# Elements whose whole content is no text; elements that aren't the article; elements that end a block.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "xmp")
ASIDE = ("nav", "aside", "form", "footer", "menu", "dialog", "select", "button", "svg", "math", "canvas", "audio", "video", "head", "fieldset", "label", "datalist")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark boxes around an article.
BOXES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert alerts "
    "sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead comment comments disqus respond replies reply share sharing social related "
    "recommended recommendations newsletter subscribe subscription popup modal overlay widget widgets toolbar login signin signup search pagination pager paywall complementary contentinfo".split()
)
#: Of those, what an article element may be; and words of classes that only say what is beside.
BOX_ARTICLES = frozenset("comment comments reply replies respond ad ads advert advertisement sponsored promo related recommended teaser".split())
BESIDE = frozenset("with has no without".split())
# fixed values end

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_BOX = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _boxed(name: str, rest: str, inside: bool, aside: frozenset) -> bool:
    """If an element stands beside the article, by its name or what its attributes say."""
    if name in aside or (name == "header" and not inside):
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    boxes = BOX_ARTICLES if name == "article" else BOXES
    if _HIDDEN.search(rest):
        return True
    for m in _BOX.finditer(rest):
        words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower())
        if not boxes.isdisjoint(words) and BESIDE.isdisjoint(words):
            return True
    return False


def lines(page: str, aside: frozenset = frozenset(ASIDE)) -> list[tuple[str, int, bool]]:
    """The blocks of a page that stand in no box (elements of ``aside``, or marked as one): text, its characters in links, and if in article or main."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = depth = inside = anchor = 0
    skip = ""

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, inside > 0))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        name = m["name"]
        if not name:
            token = m[0]
            if m["raw"] or token.startswith(("<!", "<?")):
                if not skip and token[:9].upper() == "<![CDATA[":
                    parts.append(token[9:].removesuffix("]]>"))
            elif not skip:
                text = html.unescape(token)
                parts.append(text)
                linked += len(text) if anchor else 0
            continue
        name, ends = name.lower(), bool(m["end"])
        if skip:
            if name == skip and name not in VOID:
                depth += -1 if ends else not m["rest"].rstrip().endswith("/")
                if depth <= 0:
                    skip = ""
            elif skip in ("p", "li", "dt", "dd") and name in BLOCK:  # its end tag may be left out
                skip = ""
            elif ends and name in ("body", "html"):
                skip = ""
            if skip or ends:
                continue
        if name in BLOCK:
            close()
        elif name == "br":
            parts.append(" ")
        if ends:
            if name in ("article", "main"):
                inside = max(0, inside - 1)
            elif name == "a":
                anchor = 0
        elif name not in VOID:
            if _boxed(name, m["rest"], inside > 0, aside):
                close()
                skip, depth = name, 1
            elif name in ("article", "main"):
                inside += 1
            elif name == "a":
                anchor = 1
    close()
    return out


def _stretches(size: np.ndarray, window: int, surge: int, dive: int) -> np.ndarray:
    """The lines from each surge of the windowed weight to the dive after it."""
    keep, k = np.zeros(len(size), bool), 0
    total = np.convolve(size, np.ones(window, int))[window - 1 :]  # of a line and those after it
    while k < len(size):
        if total[k] >= surge and size[k]:
            while k < len(size) and total[k] >= dive:
                keep[k] = size[k] > 0
                k += 1
            keep[k : k + window - 1] |= (size[k : k + window - 1] > 0) & (np.cumsum(size[k : k + window - 1] == 0) == 0)
        else:
            k += 1
    return keep


def main_lines(found: list[tuple[str, int, bool]], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[str]:
    """The lines from each surge of the windowed text length to the dive after it, on every page that surges.

    A line weighs its text length, link lists nothing; a stretch starts at the first line with text of a
    window of at least ``surge``, and ends before a window under ``dive``. Article and main elements are a
    weight and a bound: a line in one weighs ``dive`` more (a link list there under a ``window``-th of it, which
    holds a stretch but starts none), windows don't reach over their edges, and where at least half of the
    text of all stretches is theirs, stretches outside go. Pages without a surge keep all lines of weight.
    """
    if not found:
        return []
    links = np.array([linked > LINKED * len(t) for t, linked, _ in found])
    inside = np.array([i for _, _, i in found])
    length = np.array([len(t) for t, _, _ in found])
    size = np.where(links, 0, length) + inside * np.where(links, (dive - 1) // window, dive)
    edges = [0, *(np.flatnonzero(np.diff(inside)) + 1).tolist(), len(size)]
    keep = np.concatenate([_stretches(size[a:b], window, surge, dive) for a, b in zip(edges, edges[1:])])
    if not keep.any():
        keep = size > 0
    elif 2 * length[keep & inside].sum() >= length[keep].sum():
        keep &= inside
    return [t for (t, _, _), k in zip(found, keep) if k]


def main_text(page: str | None) -> str:
    """The main text of a page, a block per line. A page that stands wholly in a form is read with its form."""
    page = page or ""
    found = lines(page)
    if not found and re.search(r"<form\b", page, re.I):
        found = lines(page, frozenset(ASIDE) - {"form"})
    return "\n".join(main_lines(found))


def _extract(frames):
    for frame in frames:
        frame["text"] = [main_text(p) for p in frame.pop("html")]
        frame["n_chars"] = frame["text"].str.len().astype("int64") if len(frame) else pd.Series(dtype="int64")
        yield frame[["page_id", "url", "text", "n_chars"]]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html, ...)``.

    The markup is cut into block lines without scripts, styles and the boxes around an article; the text
    lengths over sliding windows of lines then tell where the main text surges and dives. Character
    references are decoded, white space inside a block is one space. Null html is an empty page with an
    empty text; broken markup is read on as far as it goes; repeated rows are read each.
    """
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
