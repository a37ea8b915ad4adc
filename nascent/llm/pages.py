"""Main text of web pages by tag-path ratios.

A page is read once, as browsers read it: comments, scripts and styles are skipped,
paragraphs and list items close one another, unknown end tags are ignored. Every run of
text between block borders is a node with its root-to-leaf path of block tags. For each
path the text length, the punctuation and the linked length of its nodes are added up; the
path's ratio is text per node, weighted by punctuation and by the share that is no link
(Wu et al., 2013). Along the page the ratios are smoothed with a Gaussian window, then
fused with the ratio of the path's container, so that a heading, a short paragraph or a list
goes with the text around it. Nodes above a share of the page's best score are the main text.

Elements that are no article by their meaning (menus, page headers and footers, asides,
forms, adverts, notices, reader comments, hidden parts) give no nodes. A marked article or
main part is a prior: what lies outside counts less and must outdo the best inside; inside,
a smaller share of the best score is enough. There the window stays within one container,
so that a box without a mark, such as an advert or links to other stories, stands for itself
and does not live on its neighbours' ratios, while links listed in the text stay with it.

Defined results: null, empty or text-free html gives an empty text; html without tags is
one block; very long pages are read whole; repeated rows are repeated; a page of equal
scores keeps all nodes; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import bounded_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")
WORDS = re.compile(r"[a-z]+")

RAW = {"script", "style", "noscript", "iframe", "template", "textarea", "title", "svg", "object", "math", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul button caption label legend video audio canvas".split()
)
#: What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
NO_ARTICLE = {"nav", "footer", "aside", "form", "dialog", "button", "menu", "head", "label", "fieldset"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "menu", "form"}
#: Words of class and id that mark no article anywhere, and those that do so outside one.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted sidebar sidenav "
    "breadcrumb breadcrumbs navbar navigation cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond login signup pagination pager toolbar widget widgets skip copyright".split()
)
OUTER_MARKS = {"header", "footer", "nav", "menu", "masthead", "aside", "top", "bottom", "search", "form"}
CONTAINERS = {"article", "main"}
NESTED = set("ul ol li dl dd table tbody thead tfoot tr blockquote figure header hgroup".split())


@dataclass(frozen=True)
class PathSettings:
    sigma: float = 1.0
    threshold: float = 0.2
    inside: float = 0.05
    outside: float = 0.25


@dataclass
class Node:
    path: tuple[str, ...]
    text: str
    linked: int
    inside: bool


@dataclass
class _Reader:
    """Open block elements and the text gathered since the last block border."""

    stack: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # tag, label, left out, inside
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    nodes: list[Node] = field(default_factory=list)

    def border(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            top = self.stack[-1] if self.stack else ("", "", False, False)
            if text and not top[2]:
                path = tuple(label for _, label, _, _ in self.stack)
                self.nodes.append(Node(path, text, min(self.linked, len(text)), top[3]))
            self.parts, self.linked = [], 0

    def text(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def open(self, tag: str, attributes: str) -> None:
        if self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        closes, ends = CLOSES.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in ends:
                break
            if self.stack[i][0] in closes:
                del self.stack[i:]
                break
        left_out, inside = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (False, False)
        label = tag
        if attributes.strip(" /"):
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            name = found.get("class") or found.get("id") or ""
            label = f"{tag}.{name.split()[0]}" if name.split() else tag
            words = set(WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            marked = words & MARKS or (not inside and words & OUTER_MARKS) or found.get("role", "").lower() in ROLES
            left_out = left_out or hidden or (bool(marked) and tag not in ("html", "body"))
        left_out = left_out or tag in NO_ARTICLE or (tag == "header" and not inside)
        self.stack.append((tag, label, left_out, inside or tag in CONTAINERS))


def nodes_of(page: str) -> list[Node]:
    """The text nodes of a page in order, without those of elements that are no article."""
    reader, at = _Reader(), 0
    while (match := TAG.search(page, at)) is not None:
        if match.start() > at:
            reader.text(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing = bool(match[1])
        if tag in RAW and not closing:
            if not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            reader.in_link = not closing
        elif tag in ("br", "hr"):
            reader.text(" ")
        elif tag in BLOCKS:
            reader.border()
            if closing:
                reader.close(tag)
            elif tag not in VOID:
                reader.open(tag, match[3] or "")
    reader.text(page[at:])
    reader.border()
    return reader.nodes


def _ratio(nodes: list[Node]) -> float:
    """Text per node, more with punctuation, less with links."""
    length = sum(len(n.text) for n in nodes)
    marks = sum(len(PUNCTUATION.findall(n.text)) for n in nodes)
    linked = sum(n.linked for n in nodes)
    free = 1 - linked / max(length, 1)
    return length / len(nodes) * (1 + min(marks / len(nodes), 5)) * (free if free > 0.2 else 0.0)


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of what a node stands in; lists and tables count as part of it."""
    path = path[:-1]
    while path and path[-1].split(".")[0] in NESTED:
        path = path[:-1]
    return path


def _ratios(nodes: list[Node], paths: list[tuple[str, ...]]) -> np.ndarray:
    groups: dict[tuple[str, ...], list[Node]] = {}
    for node, path in zip(nodes, paths, strict=True):
        groups.setdefault(path, []).append(node)
    known = {path: _ratio(group) for path, group in groups.items()}
    return np.array([known[path] for path in paths])


def _smoothed(values: np.ndarray, paths: list[tuple[str, ...]], sigma: float) -> np.ndarray:
    """Gaussian means along the nodes of each path."""
    reach = max(1, int(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    places: dict[tuple[str, ...], list[int]] = {}
    for place, path in enumerate(paths):
        places.setdefault(path, []).append(place)
    smooth = np.empty(len(values))
    for at in places.values():
        weights = np.convolve(np.ones(len(at)), window)[reach:-reach]
        smooth[at] = np.convolve(values[at], window)[reach:-reach] / weights
    return smooth


def main_text(page: str | None, settings: PathSettings | None = None) -> str:
    """The main text of a page, blocks joined by an empty line."""
    settings = settings or PathSettings()
    nodes = nodes_of(page or "")
    if not nodes:
        return ""
    containers = [_container(n.path) for n in nodes]
    own, around = _ratios(nodes, [n.path for n in nodes]), _ratios(nodes, containers)
    score = np.maximum(_smoothed(own, [()] * len(nodes), settings.sigma), around)
    inside = np.array([n.inside for n in nodes])
    if inside.any():
        score = np.where(inside, score, score * settings.outside)
    chosen = (score >= settings.threshold * score.max()) & (own > 0)
    if inside.any():
        outer = chosen & (score >= score[inside].max())
        within = np.maximum(_smoothed(own, containers, settings.sigma), around)
        kept = (within >= settings.inside * within[inside].max()) & (within > 0)
        chosen = np.where(inside, kept, outer)
    return "\n\n".join(n.text for n, keep in zip(nodes, chosen, strict=True) if keep)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: PathSettings | None = None
) -> DataFrame:
    """``(id, url, text)``, one row per row of ``pages``; no shuffle."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v, settings) for v in values])

    return pages.select(F.col(id_col), F.col(url_col), texts(F.col(html_col).cast("string")).alias("text"))
