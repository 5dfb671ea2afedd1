"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. For each path, the mean length of text outside links
and the mean punctuation of its nodes are taken, smoothed over the paths that follow each other on the page, and fused
with two more features of the path: the share of its text in links, and whether an element on it has a name that says
article or boilerplate. Paths that score well are content. The smallest element that holds all content is the region;
in it the deepest element that holds most content is the core, of which everything is kept but what scores as
boilerplate or lists of links. So a short paragraph is kept for what its path holds elsewhere on the page, and a heading
for where it stands. All sums go once up the tree, so time grows with the page's length, however deep its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import rows_out

#: Fixed values of HTML: elements without an end tag, elements whose content is not markup, elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed values of HTML: elements that an opening tag ends without an end tag of theirs.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements, roles and words of class and id that say boilerplate.
DROPPED = frozenset("nav footer aside form button select dialog menu svg head object canvas fieldset".split()) | RAW
OUTSIDE_ONLY = frozenset({"header"})  # boilerplate unless it belongs to the article
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar skip pager pagination".split()
)
HEADER_MARKS = frozenset("header masthead topbar".split())
#: A path is content from this share of the best score on; the article's core holds this share of the content's text.
CONTENT_SHARE, ARTICLE_SHARE = 0.2, 0.6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text but no article.
NO_CORE = HEADINGS | frozenset("p li blockquote pre td".split())
#: A path with more than this share of text in links is a list of links.
LINK_SHARE = 0.6
#: What a path's ratio is multiplied by if an element on it is named as article, and as boilerplate.
NAMED_ARTICLE, NAMED_BOILERPLATE = 50.0, 1e-6

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？؟،।]")
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class _Page:
    """Elements (tag, parent, is boilerplate by tag, is by class) and text blocks (element, text, link characters)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.marked = ["#"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.svg = [False]
        self._read(source)

    def _open(self, tag: str, attrs: str, above: int) -> int:
        words: set[str] = set()
        role = ""
        if "=" in attrs:
            for name, a, b, c in ATTR.findall(attrs):
                if name.lower() == "role":
                    role = (a or b or c).strip().lower()
                else:
                    words.update(x.lower() for x in PART.findall(a or b or c))
        self.tag.append(tag)
        self.parent.append(above)
        self.svg.append(self.svg[above] or tag == "svg")
        self.dropped.append(tag in DROPPED or role in ROLES)
        self.marked.append(tag not in ("html", "body", "main", "article") and (tag in OUTSIDE_ONLY or bool(words & MARKS) or bool(words & HEADER_MARKS)))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, held, linked, at, place = [0], [], 0, 0, 0
        links, blank = 0, True
        is_open: dict[str, int] = {}  # elements of each name on the stack, so that an end tag without one costs nothing

        def close(k: int) -> None:
            nonlocal links
            for x in stack[k:]:
                links -= self.tag[x] == "a"
                is_open[self.tag[x]] -= 1
            del stack[k:]

        def flush() -> None:
            nonlocal linked, blank
            text = " ".join("".join(held).split())
            if text:
                self.blocks.append((place, text, linked))
            held.clear()
            linked, blank = 0, True

        def say(text: str) -> None:
            nonlocal linked, place, blank
            if not text:
                return
            text = html.unescape(text) if "&" in text else text
            if blank and not text.isspace():
                blank = False
                k = len(stack) - 1
                while k and self.tag[stack[k]] in INLINE:
                    k -= 1
                place = stack[k]
            held.append(text)
            if links:
                linked += len(text.strip())

        while True:
            m = TAG.search(source, at)
            if not m:
                break
            say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1) if is_open.get(tag) else ():
                    if self.tag[stack[k]] == tag:
                        if tag not in INLINE:
                            flush()
                        close(k)
                        break
                    if tag in INLINE and self.tag[stack[k]] not in INLINE:
                        break
                continue
            if tag == "br":
                held.append(" ")
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag not in INLINE:
                flush()
                while len(stack) > 1 and self.tag[stack[-1]] in INLINE:  # an open <b> does not outlive its block
                    close(len(stack) - 1)
                if self.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
            if tag in ENDS and any(is_open.get(x) for x in ENDS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in ENDS[tag]:
                        close(k)
                        break
                    if name in SCOPE[tag]:
                        break
            own = self._open(tag, m[3] or "", stack[-1])
            if (m[3] or "").endswith("/") and tag not in RAW and self.svg[own]:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(own)
            is_open[tag] = is_open.get(tag, 0) + 1
            links += tag == "a"
        say(source[at:])
        flush()

    def text(self) -> str:
        if not self.blocks:
            return ""
        n, tag, parent = len(self.tag), self.tag, self.parent
        # Elements are numbered as they open, so those within e are the numbers from e to last[e].
        last, holds = list(range(n)), [t in ("article", "main", "h1") for t in tag]
        for e in range(n - 1, 0, -1):
            up = parent[e]
            last[up] = max(last[up], last[e])
            holds[up] |= holds[e]
        # A path is its parent's path, the tag and what its name says; paths are numbered as they occur.
        number: dict[tuple[int, str, float], int] = {}
        path, said, inside, heading = [0] * n, [1.0] * n, [False] * n, [False] * n
        for e in range(1, n):
            up = parent[e]
            inside[e] = inside[up] or tag[e] in ("article", "main")
            heading[e] = heading[up] or tag[e] in HEADINGS
            boilerplate = self.dropped[e] or (self.marked[e] and not (inside[up] and tag[e] == "header") and not holds[e])
            said[e] = NAMED_BOILERPLATE if boilerplate or said[up] < 1 else NAMED_ARTICLE if inside[e] else 1.0
            path[e] = number.setdefault((path[up], tag[e], said[e]), len(number) + 1)
        # Tag-path ratios: mean length and mean punctuation of a path's nodes, smoothed, fused with links and names.
        sums: dict[int, list[float]] = {}
        for e, t, linked in self.blocks:
            s = sums.setdefault(path[e], [0, 0, 0, 0, said[e]])
            s[0] += 1
            s[1] += len(t) - linked
            s[2] += len(PUNCTUATION.findall(t))
            s[3] += linked
        raw = [(s[1] / s[0]) * (1 + s[2] / s[0]) for s in sums.values()]  # in the order in which paths first occur
        smooth = [(raw[max(i - 1, 0)] + 6 * r + raw[min(i + 1, len(raw) - 1)]) / 8 for i, r in enumerate(raw)]
        score = {p: r * (1 - s[3] / max(s[1] + s[3], 1)) * s[4] for (p, s), r in zip(sums.items(), smooth, strict=True)}
        named_well = [score[p] for p, s in sums.items() if s[4] >= 1]
        if not named_well:
            return ""  # nothing but boilerplate
        least = CONTENT_SHARE * max(named_well)
        content = {p for p, x in score.items() if x >= least}
        # Content text in each element, summed once upward.
        within = [0] * n
        for e, t, _ in self.blocks:
            if path[e] in content:
                within[e] += len(t)
        for e in range(n - 1, 0, -1):
            within[parent[e]] += within[e]
        region = core = 0
        for e in range(1, n):  # children come after their parents
            if parent[e] == region and within[e] == within[0]:
                region = e
            if parent[e] == core and within[e] >= ARTICLE_SHARE * within[0] and tag[e] not in NO_CORE:
                core = e
        # A core in an article or main element is the whole of that element.
        while inside[core] and tag[core] not in ("article", "main"):
            core = parent[core]
        region = min(region, core)
        out: list[str] = []
        headings: list[str] = []
        for e, t, linked in self.blocks:
            s = sums[path[e]]
            in_core = core <= e <= last[core]
            if path[e] in content or (in_core and s[4] >= 1 and (linked <= LINK_SHARE * len(t) or s[3] <= LINK_SHARE * (s[1] + s[3]))):
                out += [*headings, t] if out else [t]
                headings = []
            elif not in_core and region <= e <= last[region] and heading[e] and s[4] >= 1:
                headings.append(t)
        return " ".join(out)


def main_text(source: str | None) -> str:
    """The article of one page; empty for null, empty or text-free pages."""
    return _Page(source).text() if source else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield rows_out({"page_id": ids, "url": urls, "text": texts, "n_chars": list(map(len, texts))}, OUT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points); no shuffle, each page is read by itself and whole.

    Null and empty pages and pages without text give an empty text. Markup may be broken: end tags may lack,
    quotes stay open, a comment or script run to the page's end. Repeated rows are extracted each; an empty table
    gives an empty result. Only the three named columns are read, so others cannot clash.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return p.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
