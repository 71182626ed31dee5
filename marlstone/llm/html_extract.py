"""Main text of web pages: streamed parser events, text-to-tag ratios, smoothing and clustering of lines.

The standard library's parser feeds a line builder: each block of a page is one line with its number of tags and its link
text. The lines' text-to-tag ratios (link text apart) are smoothed with a Gaussian; links and what names itself boilerplate
by tag, role, class or id weigh the result down; and a threshold between two clusters splits the lines. The lines of the
upper cluster are content, or all that aren't marked or links where the clusters aren't apart. The region is the smallest container that
holds all of them, and the lines of unmarked articles beside them. Its lines are the main text, but for
those in containers without a content line that are marked as menus, headers, footers, sidebars, notices, adverts, forms or
comments, or that hold mostly links outside of an article.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.words import small_batches

# HTML elements by what they do, and the words of class, id and role that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body details dialog div footer form header html main menu nav section table td th ul ol dl".split())
BOILER_TAGS = frozenset("nav header footer aside form dialog menu".split())
BOILER_WORDS = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related replies respond share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget widgets".split())
SUFFIXES = frozenset("area bar block bottom box container inner item items left link links list message right row section slot text top unit widget wrap wrapper".split())
NEGATIONS = frozenset("has hide is no not show with without".split())
WRAPPER_WORDS = frozenset("header menu modal nav overlay sidebar toolbar widget".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
SIGMA = 1.0
#: What a mark leaves of a line's smoothed ratio.
MARKED = 0.05
#: Share of link text from which a container without content is a list of links.
LINKS = 0.5
#: Start tags that close elements left open, and the elements that these are looked for in.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table"), "th": ("td th", "table"), "tr": ("td th", "table")}
#: What a container is by itself: content, a wrapper word's (unless it holds the whole page), a class or id's, a tag or role's.
PLAIN, WRAPPER, NAMED, FIRM = 0, 1, 2, 3


def name_mark(name: str, in_article: bool = False) -> int:
    """What a class or id says: boilerplate if its last part is a word of boilerplate ("site-footer"), or its first one is and
    the others are words of layout ("ad-slot"), numbers aside; but not "has-sidebar", nor a header within an article."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x]
    if not parts or NEGATIONS.intersection(parts) or (in_article and "header" in parts):
        return PLAIN
    word = parts[-1] if parts[-1] in BOILER_WORDS else parts[0] if parts[0] in BOILER_WORDS and SUFFIXES.issuperset(parts[1:]) else None
    return PLAIN if word is None else WRAPPER if word in WRAPPER_WORDS else NAMED


class _Lines(HTMLParser):
    """Builds lines: (text, tags, link characters, container). Containers are numbered; parent[i] is the one around i, mark[i]
    what i is by itself. ``depths`` has the places of each open container in the stack by its name, so that no tag makes
    the parser search the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.name, self.mark = [-1], [""], [PLAIN]
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.silent: list[str] = []
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.link_depth = 0  # stack size where the open link began, 0 without one
        self.tags = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, min(len(text), len(" ".join("".join(self.link_parts).split()))), self.stack[-1]))
            self.tags = 0
        self.parts, self.link_parts = [], []

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)  # as browsers do with <![x[...]]>

    def _open(self, *names) -> int:
        """The depth of the innermost open container of these names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _cut(self, depth: int):
        for c in reversed(self.stack[depth:]):
            self.depths[self.name[c]].pop()
        del self.stack[depth:]
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def _mark(self, tag, attrs):
        if tag in ("html", "body", "main"):
            return PLAIN
        in_article = self._open("article", "main") > 0
        if tag in BOILER_TAGS:
            return (PLAIN if in_article else FIRM) if tag == "header" else NAMED if tag == "form" and in_article else WRAPPER if tag == "form" else FIRM
        mark = PLAIN
        for key, value in attrs:
            if not value:
                if key == "hidden":
                    return FIRM
            elif key in ("class", "id"):
                mark = max([mark, *(name_mark(n, in_article) for n in value.split())])
            elif key == "role":
                if value.strip().lower() in BOILER_ROLES:
                    return FIRM
            elif key == "aria-hidden" and value.strip().lower() == "true":
                return FIRM
        return mark

    def _close_open(self, tag):
        """Close a p before any block, and the items and cells that a start tag ends."""
        if tag in BLOCKS and self.name[self.stack[-1]] == "p":
            self._cut(len(self.stack) - 1)
        if tag in CLOSES:
            own, scope = (x.split() for x in CLOSES[tag])
            depth = self._open(*own)
            if depth > self._open(*scope):
                self._cut(depth)

    def wrapping(self) -> list[bool]:
        """Whether a container holds all lines of the page, or all of its mains and articles: its name then tells no content
        from anything else."""
        lines, articles = np.zeros(len(self.parent), dtype=int), np.zeros(len(self.parent), dtype=int)
        np.add.at(lines, [c for _, _, _, c in self.lines], 1)
        articles[[c for c in range(1, len(self.parent)) if self.name[c] in ("article", "main")]] = 1
        for c in range(len(self.parent) - 1, 0, -1):
            lines[self.parent[c]] += lines[c]
            articles[self.parent[c]] += articles[c]
        return [bool(n == lines[0] or (articles[0] and a == articles[0])) for n, a in zip(lines, articles)]

    def marked(self, votes: np.ndarray) -> list[bool]:
        """Whether each container is marked, by itself or through one around it. A main, or an article with half of the votes,
        is not for what a class, id or form around it says, and a wrapper's word isn't one for what wraps the whole page."""
        soft, firm = [False], [False]
        wrapping = self.wrapping()
        for c in range(1, len(self.parent)):
            up = self.parent[c]
            half = 2 * votes[c] >= votes[0] > 0
            content = self.mark[c] == PLAIN and (self.name[c] == "main" or (self.name[c] == "article" and half))
            own = self.mark[c] == NAMED or (self.mark[c] == WRAPPER and not wrapping[c])
            soft.append(not content and (soft[up] or own))
            firm.append(firm[up] or self.mark[c] == FIRM)
        return [a or b for a, b in zip(soft, firm)]

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if self.silent[0] in ("select", "datalist") and (tag in CONTAINERS or tag == "p"):
                self.silent = []  # never closed: it holds no blocks
            elif (tag == self.silent[0] or tag in CONTAINERS and self.silent[0] not in ("head", "title")) and tag not in VOID:
                self.silent.append(tag)
                return
            elif tag == "body" and self.silent[0] in ("head", "title"):
                self.silent = []  # a head that was never closed
            else:
                return
        if tag in SILENT:
            self.silent = [tag]
            self.tags += 1
            return
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self._close_open(tag)
        self.tags += 1
        mark = self._mark(tag, attrs) if tag in BLOCKS or tag in CONTAINERS else PLAIN
        if tag in CONTAINERS or mark:
            self.parent.append(self.stack[-1])
            self.name.append(tag)
            self.mark.append(mark)
            self.depths.setdefault(tag, []).append(len(self.stack))
            self.stack.append(len(self.parent) - 1)
        if tag == "a":
            self.link_depth = len(self.stack)

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "math"):
            self.handle_starttag(tag, attrs)  # HTML knows no self-closing: <div/> opens
        elif not self.silent:
            self.tags += 1

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                return
            if tag not in CONTAINERS or not self._open(tag):
                return
            self.silent = []  # never closed: it ends with what is around it
        self.tags += 1
        if tag == "a":
            self.link_depth = 0
        if tag in BLOCKS:
            self.flush()
        if depth := self._open(tag):
            self._cut(depth)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.link_depth:
                self.link_parts.append(data)

    def tail(self, text: str):
        """What follows the last complete tag: text up to a tag that is never finished, which goes as it does in browsers."""
        rest, self.rawdata = self.rawdata, ""
        found = re.search(r"<[a-zA-Z/!?]", text)
        data = text[: found.start()] if found else text
        self.handle_data(unescape(rest + data) if not self.cdata_elem else rest + data)

    def finish(self):
        self.close()
        self.flush()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing whose weights are renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel, mode="full")[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel, mode="full")[reach : reach + len(values)]


def two_cluster_threshold(values: np.ndarray) -> float:
    """The midpoint between the centres of two clusters of numbers (Lloyd's steps from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        below, above = values[values <= middle], values[values > middle]
        if not len(above):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def upper_cluster(values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Whether each value is in the upper of two clusters, as all are if they are equal; ``otherwise`` where the clusters aren't
    apart, the lower centre not under half of the upper one."""
    upper = values >= two_cluster_threshold(values)
    return upper if upper.all() or 2 * values[~upper].mean() <= values[upper].mean() else otherwise


def _sum_up(parser: _Lines, values: np.ndarray) -> np.ndarray:
    """The sums of the lines' values in each container, those inside it included."""
    out = np.zeros(len(parser.parent))
    np.add.at(out, [c for _, _, _, c in parser.lines], values)
    for c in range(len(out) - 1, 0, -1):  # children come after their parents
        out[parser.parent[c]] += out[c]
    return out


def content_lines(parser: _Lines) -> tuple[np.ndarray, list[bool]]:
    """Whether each line is in the upper cluster, and whether each container is marked."""
    size, tags, links = (np.array(c, dtype=float) for c in list(zip(*((len(t), n, link) for t, n, link, _ in parser.lines))))
    ratio = smooth(np.log1p((size - links) / np.maximum(1, tags)))
    marked = parser.marked(_sum_up(parser, np.where(upper_cluster(ratio, np.ones(len(size), dtype=bool)), size, 0)))
    told = np.array([marked[c] for _, _, _, c in parser.lines])
    weighed = ratio * (1 - links / size) * np.where(told, MARKED, 1.0)
    plain = ~told & (links < LINKS * size)
    return upper_cluster(weighed, plain if plain.any() else ~told), marked


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks in page order, joined by a newline. Null and textless pages give '', and so do
    pages where everything is marked as boilerplate."""
    if not html:
        return ""
    parser = _Lines()
    whole = html.rfind(">") + 1  # no tag ends after the last >; the parser would look for its end from each <
    parser.feed(html[:whole])
    parser.tail(html[whole:])
    parser.finish()
    if not parser.lines:
        return ""
    content, marked = content_lines(parser)
    if all(marked[c] for _, _, _, c in parser.lines):
        return ""
    held = _sum_up(parser, content)
    within = [False]
    for c in range(1, len(parser.parent)):
        within.append(not marked[c] and (within[parser.parent[c]] or parser.name[c] in ("article", "main")))
    # A short article beside a long one is no less one: the region holds both.
    spoken = _sum_up(parser, content | np.array([within[c] and 2 * n < len(t) for t, _, n, c in parser.lines]))
    region = int(np.flatnonzero(spoken == spoken[0])[-1])  # the containers that hold all of it are nested: the last is the innermost
    size, links = _sum_up(parser, np.array([len(t) for t, _, _, _ in parser.lines])), _sum_up(parser, np.array([n for _, _, n, _ in parser.lines]))
    article, kept = [False], [region == 0]
    for c in range(1, len(parser.parent)):
        up = parser.parent[c]
        article.append(article[up] or (parser.name[c] in ("article", "main") and not marked[c]))
        refused = not held[c] and (marked[c] or (not article[c] and size[c] > 0 and links[c] >= LINKS * size[c]))
        kept.append(c == region or (kept[up] and not refused))
    return "\n".join(t for t, _, _, c in parser.lines if kept[c])


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, have an empty text. Repeated rows are extracted each on their own.
    A page of any length or depth is read whole, in time and memory in proportion to it. Page ids must be integers or null;
    an empty table gives no rows; other columns are not read.
    """

    def parse(batches):
        for batch in small_batches(batches, 2):
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=EXTRACTED.fieldNames())

    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html)).mapInArrow(parse, EXTRACTED)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
