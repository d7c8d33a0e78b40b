"""Main text of HTML pages by scoring the tree: the container whose paragraphs say most, with the siblings that read like it.

A page is parsed to its elements in document order. Elements that are not
article text by what they are called (menus, headers, footers, asides, forms,
scripts, adverts, notices, reader comments) go first. Every paragraph then
passes points for its length and commas to its ancestors, less with every
level; a container's points are discounted by the share of its text that is
links. The best container is kept with its siblings of similar score or
paragraph form, and the headings before it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Block elements whose start tag does not end an open paragraph.
_INSIDE = frozenset("body caption dd dt head html li tbody td tfoot th thead tr".split())
PARAGRAPHS = frozenset("p li dd dt td th pre blockquote figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of the second set, unless one of the third lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "a": ({"a"}, set(BLOCKS)),
    **{h: (set(HEADINGS), set(BLOCKS) - HEADINGS) for h in HEADINGS},
}
_PARAGRAPH_ENDS = ({"p"}, {"td", "th", "caption", "button", "table", "body", "html"})
#: Elements and words in class, id and role that mark what is not article text.
NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside menu button select textarea iframe object embed svg math canvas audio video dialog search xmp noembed noframes".split()
)
NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer footnav copyright colophon sidebar rail aside "
    "related recommended recommendations trending popular widget widgets ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner "
    "sponsor sponsored sponsors promo promos promotion promoted taboola outbrain cookie cookies consent gdpr notice notices notification notifications alert toast popup "
    "modal overlay lightbox paywall newsletter subscribe subscription signup signin login search searchbox share sharing social comment comments respond replies "
    "disqus discussion complementary contentinfo skip hidden".split()
)
_MODIFIERS = frozenset("has no with without is show hide js".split())
_ARTICLE_WORDS = frozenset("article post entry story content section".split())

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s"'>]++)))?""", re.S | re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


class Page:
    """Elements and texts of a page in document order; a subtree is a range of it."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.attributes: list[str] = [""]
        self.texts: list[str] = [""]
        self.open: list[int] = [0]
        self.open_tags: Counter[str] = Counter()
        self._read(source)
        self.ends = list(range(1, len(self.tags) + 1))
        for i in range(len(self.tags) - 1, 0, -1):
            self.ends[self.parents[i]] = max(self.ends[self.parents[i]], self.ends[i])

    def _add(self, tag: str, attributes: str = "", text: str = "") -> int:
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.attributes.append(attributes)
        self.texts.append(text)
        return len(self.tags) - 1

    def _cut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.open_tags[self.tags[i]] -= 1
        del self.open[depth:]

    def _close(self, kinds: set[str], barrier: set[str]) -> None:
        if not any(self.open_tags[kind] for kind in kinds):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in kinds:
                self._cut(depth)
                return
            if tag in barrier:
                return

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at:
                self._add("#text", "", html.unescape(source[at:stop]))
            if not found:
                return
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            if tag in BLOCKS and tag not in _INSIDE:
                self._close(*_PARAGRAPH_ENDS)
            if tag in _ENDS:
                self._close(*_ENDS[tag])
            if tag in ("html", "body") and self.open_tags[tag]:
                continue
            if tag == "body":
                self._close({"head"}, set())
            made = self._add(tag, found[3])
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
            if tag not in VOID:
                self.open.append(made)
                self.open_tags[tag] += 1

    def _end(self, tag: str) -> None:
        if not self.open_tags[tag]:
            if tag == "p":
                self._add("p")
            return
        inline = tag not in BLOCKS and tag not in RAW
        for depth in range(len(self.open) - 1, 0, -1):
            open_tag = self.tags[self.open[depth]]
            if open_tag == tag:
                self._cut(depth)
                return
            if (inline and open_tag in BLOCKS) or (tag not in ("html", "body", "table") and open_tag in ("td", "th", "table")):
                return


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def _noisy_name(name: str) -> bool:
    words = _words(name)
    return bool(words) and words[0] not in _MODIFIERS and any(w in NOISE_WORDS for w in words)


def _noise(page: Page) -> list[bool]:
    """Which elements are dropped with all they hold."""
    holds = [False] * len(page.tags)  # a main part or a first heading
    within = [False] * len(page.tags)  # an article or main part
    for i in range(len(page.tags) - 1, 0, -1):
        if holds[i] or page.tags[i] in ("main", "h1"):
            holds[page.parents[i]] = True
    articles = [False] * len(page.tags)
    for i in range(len(page.tags) - 1, 0, -1):
        if articles[i] or page.tags[i] in ("main", "article"):
            articles[page.parents[i]] = True
    out = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag, up = page.tags[i], page.parents[i]
        within[i] = within[up] or page.tags[up] in ("article", "main")
        if out[up] or tag == "#text":
            out[i] = out[up]
            continue
        named = {n.lower(): a or b or c for n, a, b, c in _NAMED.findall(page.attributes[i])} if page.attributes[i] else {}
        if tag in NOISE_TAGS or (tag == "form" and not articles[i]):
            out[i] = True
        elif tag in ("html", "body", "article", "main") and not ("article" == tag and "comment" in named.get("class", "").lower()):
            pass
        elif "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
            out[i] = True
        elif tag not in HEADINGS and named:
            names = [*named.get("class", "").split(), named.get("id", ""), *named.get("role", "").split()]
            if any(_noisy_name(n) for n in names):
                out[i] = not holds[i]
            elif any("header" in (w := _words(n)) and not _ARTICLE_WORDS & set(w) for n in names) or named.get("role") == "banner":
                out[i] = not within[i] and not articles[i]
        if tag == "header" and not within[i] and not articles[i]:
            out[i] = not any(_ARTICLE_WORDS & set(_words(n)) for n in named.get("class", "").split())
    return out


class Blocks:
    """Runs of kept text between block boundaries: container, text, linked share, where it stands."""

    def __init__(self, page: Page, noise: list[bool]) -> None:
        self.rows: list[tuple[int, int, str, int]] = []  # container, first text node, text, linked code points
        self.block = block = [0] * len(page.tags)  # the nearest block element, itself included
        linked = [False] * len(page.tags)
        parts: list[tuple[str, bool]] = []
        container, first, breaks, lines = -1, 0, False, 0

        def close() -> None:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                inside = len(" ".join("".join(p if in_link else " " for p, in_link in parts).split()))
                self.rows.append((container, first, text, min(inside, len(text))))
            parts.clear()

        for i in range(1, len(page.tags)):
            tag, up = page.tags[i], page.parents[i]
            block[i] = i if tag in BLOCKS else block[up]
            linked[i] = linked[up] or tag == "a"
            if tag in BLOCKS:
                breaks = True
            if noise[i]:
                continue
            if tag == "br":
                lines += 1
                breaks = breaks or lines > 1
                parts.append((" ", linked[i]))
            elif tag == "#text":
                if block[i] != container or breaks:
                    if not page.texts[i].strip() and block[i] == container and not breaks:
                        continue
                    close()
                    container, first, breaks = block[i], i, False
                parts.append((page.texts[i], linked[i]))
                if page.texts[i].strip():
                    lines = 0
        close()


def _points(text: str) -> float:
    return min(1.0, len(text) / 25) + sum(text.count(c) for c in ",،、，") + min(len(text) / 100, 3.0)


def main_text(source: str | None) -> str:
    """The article's blocks, one per line, each with single spaces; empty for a page without text (or null)."""
    page = Page(source or "")
    noise = _noise(page)
    blocks = Blocks(page, noise)
    rows = blocks.rows
    n = len(page.tags)
    inner = [False] * n  # has block elements inside
    for i in range(1, n):
        if page.tags[i] in BLOCKS and not noise[i]:
            inner[page.parents[i]] = True
    for i in range(n - 1, 0, -1):
        if inner[i] and page.tags[i] not in BLOCKS:
            inner[page.parents[i]] = True
    score, chars, links, anchors = [0.0] * n, [0] * n, [0] * n, [0] * n
    for container, _, text, inside in rows:
        chars[container] += len(text)
        links[container] += inside
        if page.tags[container] in HEADINGS:
            continue
        passes = page.tags[container] in PARAGRAPHS or (not inner[container] and page.tags[container] not in ("body", "html", "#root", "article", "main"))
        at, points = (blocks.block[page.parents[container]] if passes else container), _points(text)
        for share in (1, 2, 6, 9, 12, 15):
            if at > 0:
                score[at] += points / share
                at = blocks.block[page.parents[at]]
    for i in range(n - 1, 0, -1):
        anchors[i] += page.tags[i] == "a" and not noise[i]
        for sums in (chars, links, anchors):
            sums[page.parents[i]] += sums[i]
    density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    final = [score[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i), default=0)
    if not final[best]:
        best = 0
    at = best
    while at > 0:  # an article is taken whole; a main part too, if there is no article in between
        if page.tags[at] in ("article", "main"):
            best = at
            break
        at = page.parents[at]
    kept = [False] * n
    kept[best] = True
    up = page.parents[best]
    for i in range(1, n):
        if up < 0 or page.parents[i] != up or noise[i] or i == best:
            continue
        tag = page.tags[i]
        reads = density[i] < 0.25 and (chars[i] > 80 or (chars[i] > 0 and page.tags[best] not in ("article", "main"))) and tag in PARAGRAPHS
        same = page.tags[best] == tag and final[i] >= 0.2 * final[best] and final[i] > 0
        alike = page.tags[best] not in ("article", "main") and final[i] >= max(10.0, 0.2 * final[best])
        loose = tag not in BLOCKS and page.tags[best] not in ("article", "main", "body") and chars[i] > 80
        kept[i] = reads or same or alike or loose or (tag in HEADINGS and page.tags[best] not in ("article", "main"))
    at = best
    while at > 0:  # the title may stand before the container
        for i in range(page.parents[at] + 1, at):
            if page.parents[i] == page.parents[at] and page.tags[i] in ("h1", "h2") and not noise[i]:
                kept[i] = True
        at = page.parents[at]
    menu = [False] * n  # lists of links inside the article
    for i in range(1, n):
        kept[i] = kept[i] or kept[page.parents[i]]
        menu[i] = menu[page.parents[i]] or (
            page.tags[i] in ("ul", "ol", "dl", "div", "section", "table") and anchors[i] >= 3 and density[i] >= 0.75
        )
    return "\n".join(text for _, first, text, _ in rows if kept[first] and not menu[first])


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """Every page with its main ``text`` and ``n_chars``, its code points; columns of these names are replaced.

    Pages are judged on their own, row by row, over the whole source, so
    nothing is shuffled and a task holds one page's tree at a time. Null and
    empty pages have an empty text; repeated pages each keep their row. Texts
    that no markup surrounds are one block. A line break is a space, two on
    end part blocks.
    """
    kept = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars")])
    if source not in kept.columns:
        raise ValueError(f"no column {source}")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(s.as_py()) for s in part.column(source)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names, "text", "n_chars"],
                )

    return kept.mapInArrow(run, schema)
