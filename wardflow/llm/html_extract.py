"""Main-text extraction by consensus host paths.

Pass one picks the generalised container path (tag and class names, digits as
``#``) around the whole text of every page; Spark sums the votes per host.  Pass
two extracts every page again with its host's winning path.  Containers of one
path count together.  The pick starts at the deepest path that holds at least
90% of the page's clean text outside links, and climbs to every path above that
adds article text: a heading, text right beside the container, a sentence, or
40 characters in all.  An ``article`` or ``main`` with at least half of the text
is taken as the author's own mark: the pick starts there, and climbs only for a
headline (``h1``) that it lacks, within a ``main`` or, if it has no heading at
all, anywhere.  A page votes for its pick and for the paths above that hold the
very same text, so pages without a lead do not outvote those with one.  A path
has one vote a page, and votes are whole numbers, so the winner does not depend
on the order of rows.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are known by element and by class, id or role name, and are left
out of votes and text alike.  A name counts as a whole (``sidebar``) or with
neutral words and numbers (``sidebar-2``, ``comment-list``, ``site-footer``), not
where it only tells of such a part (``no-sidebar``, ``comments-open``,
``content-sidebar-wrap``); ``html``, ``body`` and ``main`` are never left out by a
name, an ``article`` only by a whole one.  A block is the text between two
block-level tags.  If nothing is left of a page, it is read again with forms,
then without regard to names, then with every element but the head; such a page
does not vote.

Defined cases: a null page is empty; a page without any text gives an empty
text; a page that lacks its host's path uses its own best path; a page without
a host (null or odd url) votes with the others of that kind; equal votes go to
the later path in string order; repeated rows vote and are returned row by row;
an empty table gives an empty result; a tag that the page's end cuts off is
dropped; a quote that does not follow ``=`` is an ordinary character of its tag; in
a path, what is above a container is a hash where it is over 240 characters long;
other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import write_table

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
DROPPED = frozenset("aside button datalist dialog footer form head menu nav select".split())
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
             "option": "option", "tbody": "tbody thead tr td th"}
#: Names that mark a part of the page as not the article.
NOISE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promoted promotion related replies reply respond share sharing sidebar "
    "signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split())
HEADER = frozenset("header topbar".split())
#: Words that may stand before and after such a name, and those that make a header the article's own.
BEFORE = frozenset("bottom desktop footer global google left main mobile page primary right secondary site sub top".split())
OWN = frozenset("article entry post story".split())
AFTER = frozenset(
    "area articles bar block body bottom box button buttons count desktop form heading icon icons inner item items left "
    "link links list main message mobile policy posts primary right secondary section slot stories text thread title top "
    "trail unit".split())
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
FORMS = frozenset("button dialog form".split())
#: Share of the text that a pick starts from (percent), length at which added text counts by itself.
NEARLY_ALL = 90
PART_CHARS = 40
#: A path above a container is written as its hash if it is longer than this.
LONG_PATH = 240
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS = (".", "!", "?", "\u2026", "\u3002", "\uff01", "\uff1f")

# a quote opens a value only after "="; a tag whose value never ends is read up to its first ">"
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>"""
                 r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")


@lru_cache(65536)
def _marks(name: str, kind: frozenset[str], before: frozenset[str]) -> bool:
    """Whether a class, id or role name stands for a part of that kind."""
    parts = [x for x in PARTS.split(name) if x]
    at = [i for i, x in enumerate(parts) if x in kind]
    return bool(at) and all(x in kind or (x in before if i < at[0] else x in AFTER) for i, x in enumerate(parts))


class Element(NamedTuple):
    """An open element, with what it takes over from those around it."""

    tag: str
    container: int
    left_out: bool
    article: bool  # inside an article or main, or one itself
    heading: str  # the heading around its text, up to the container
    block: int  # place on the stack of the innermost block that is no heading


class Page:
    """Containers ``(parent, tag, path number)`` and clean blocks ``(container, text, link characters, heading)`` of a page.

    Reading takes time and memory in proportion to the page, however deep or badly
    closed its elements are.
    """

    def __init__(self, source: str) -> None:
        for self.level in range(4):
            self.nodes: list[tuple[int, str, int]] = [(-1, "body", 0)]
            self.paths: list[str] = ["body"]
            self._path_of: dict[tuple[int, str], int] = {}
            self.blocks: list[tuple[int, str, int, str]] = []
            self._read(source)
            if self.blocks or not source:
                return

    def _path(self, above: int, label: str) -> int:
        """Number of the path that ``label`` continues."""
        at = self._path_of.get((above, label))
        if at is None:
            at = self._path_of[above, label] = len(self.paths)
            upper = self.paths[above]
            if len(upper) > LONG_PATH:
                upper = "~" + blake2b(upper.encode("utf-8", "replace"), digest_size=16).hexdigest()
            self.paths.append(f"{upper}>{label}")
        return at

    @staticmethod
    def _names(attributes: str) -> tuple[list[str], list[str]]:
        """(class names, class, id and role names), in lower case."""
        classes, names = [], []
        for kind, a, b, c in NAMES.findall(attributes):
            value = (a or b or c).lower().split()
            names.extend(value)
            if kind.lower() == "class":
                classes.extend(value)
        return classes, names

    def _left_out(self, tag: str, names: list[str], article: bool) -> bool:
        """Whether an element is no part of the text; ``article`` tells that it stands inside an article."""
        if tag == "head":
            return True
        if tag in ("html", "body") or self.level == 3:
            return False
        if tag in DROPPED and not (self.level and tag in FORMS):
            return True
        if tag == "header" and not article and not any(OWN & set(PARTS.split(x)) for x in names):
            return True
        if tag == "main" or self.level == 2:
            return False
        if tag == "article":
            return any(x.rstrip("-_0123456789") in NOISE for x in names)
        return any(_marks(x, NOISE, BEFORE | OWN) or (not article and _marks(x, HEADER, BEFORE)) for x in names)

    def _read(self, source: str) -> None:
        stack = [Element("", 0, False, False, "", 0)]
        open_tags: Counter[str] = Counter()
        unended: set[str] = set()  # raw elements without an end in the rest of the page
        held: list[str] = []
        links = linked = 0
        body = False

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1].container, text, linked, stack[-1].heading))
                held.clear()
            linked = 0

        def close(at: int) -> None:
            nonlocal links
            if any(x.tag in BLOCK for x in stack[at:]):
                flush()
            for x in stack[at:]:
                open_tags[x.tag] -= 1
                links -= x.tag == "a"
            del stack[at:]

        def text(piece: str) -> None:
            nonlocal linked
            if stack[-1].tag == "head" and piece.strip():
                close(len(stack) - 1)
            if stack[-1].left_out or not piece:
                return
            if "&" in piece:
                piece = html_lib.unescape(piece)
            held.append(piece)
            if links:
                linked += len(piece.strip())

        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at:m.start()])
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if open_tags[tag]:
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    close(i)
                elif tag in BLOCK:
                    flush()
                continue
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)  # its end tag may be omitted
            if tag in RAW:
                stop = None
                if tag not in unended:
                    stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    if stop is None:
                        unended.add(tag)
                at = stop.end() if stop else end if tag in ("script", "style") else at
                continue
            if tag in VOID:
                if tag == "br" and not stack[-1].left_out:
                    held.append(" ")
                elif tag in BLOCK:
                    flush()
                continue
            if tag in BLOCK:
                self._imply(tag, stack, close)
                flush()
            _, container, out, article, heading, block = stack[-1]
            if tag == "body" and not body:
                body, out = True, False
            if not out:
                classes, names = self._names(attributes) if attributes else ([], [])
                out = self._left_out(tag, names, article)
                if tag in CONTAINER and tag != "body" and not out:
                    label = ".".join([tag, *sorted({DIGITS.sub("#", x) for x in classes})])
                    self.nodes.append((container, tag, self._path(self.nodes[container][2], label)))
                    container = len(self.nodes) - 1
            if not attributes.endswith("/") or tag in BLOCK:
                if tag in HEADINGS:
                    heading = tag
                elif tag in CONTAINER:
                    heading = ""
                if tag in BLOCK and tag not in HEADINGS:
                    block = len(stack)
                stack.append(Element(tag, container, out, article or tag in ("article", "main"), heading, block))
                open_tags[tag] += 1
                links += tag == "a"
        flush()

    @staticmethod
    def _imply(tag: str, stack: list[Element], close) -> None:
        """End what a block start tag ends by itself: an open paragraph, or a sibling item."""
        at = stack[-1].block
        if at and (stack[at].tag == "p" or stack[at].tag in CLOSED_BY.get(tag, "").split()):
            close(at)

    def _paths(self) -> tuple[list[int], list[str], list[int], list[list[tuple]]]:
        """By path number, in order of the first containers: parent, tag, clean characters inside, own blocks."""
        parents, tags = [-1], ["body"]
        for parent, tag, path in self.nodes[1:]:
            if path == len(parents):
                parents.append(self.nodes[parent][2])
                tags.append(tag)
        total, own = [0] * len(parents), [[] for _ in parents]
        for x in self.blocks:
            k = self.nodes[x[0]][2]
            own[k].append(x)
            total[k] += max(0, len(x[1]) - x[2])
        for i in range(len(parents) - 1, 0, -1):
            total[parents[i]] += total[i]
        return parents, tags, total, own

    def picks(self) -> list[str]:
        """The path around the page's whole text, then the paths above that hold the same; empty without clean text."""
        parents, tags, total, own = self._paths()
        if not total[0]:
            return []
        depth, below = [0] * len(parents), [[] for _ in parents]
        for i in range(1, len(parents)):
            depth[i] = depth[parents[i]] + 1
            below[parents[i]].append(i)

        def deepest(inside: int, kinds: tuple[str, ...] = ()) -> int:
            """The deepest path, of the given tags, with nearly all of the text of ``inside``."""
            found, at = inside, inside
            while True:
                at = max(below[at], key=lambda i: total[i], default=-1)
                if at < 0 or 100 * total[at] < NEARLY_ALL * total[inside]:
                    return found
                if not kinds or tags[at] in kinds:
                    found = at

        # the outermost mark with half of the text, then the deepest one with nearly all of that one's text
        marks = [i for i in range(len(parents)) if tags[i] in ("article", "main") and 2 * total[i] >= total[0]]
        pick = (deepest(min(marks, key=lambda i: (depth[i], -total[i])), ("article", "main")) if marks else deepest(0))

        def blocks(path: int, skip: int = -1) -> list[tuple[int, str, int, str]]:
            todo, out = [path], []
            while todo:
                k = todo.pop()
                if k != skip:
                    out.extend(own[k])
                    todo.extend(below[k])
            return out

        headings = {x[3] for x in blocks(pick)} - {""}
        equal, added, same, at = [], [], True, pick
        while parents[at] >= 0:
            under, at = at, parents[at]
            more = blocks(at, under)
            same = same and not more
            if same:
                equal.append(at)
                continue
            added += [x for x in more if 2 * x[2] <= len(x[1])]
            beside = [x for x in own[at] if 2 * x[2] <= len(x[1])]
            climb = "h1" not in headings and any(x[3] == "h1" for x in added)
            if marks:
                climb = climb and (tags[at] in ("article", "main") or not headings)
            else:
                climb = (climb or bool(beside) or any(x[3] or x[1].endswith(ENDS) for x in added)
                         or sum(len(x[1]) - x[2] for x in added) >= PART_CHARS)
            if climb:
                headings |= {x[3] for x in added} - {""}
                pick, equal, added, same = at, [], [], True
        return [self.paths[i] for i in (pick, *equal)]

    def votes(self) -> dict[str, int]:
        """Votes by path: one for the page's pick and for each path above with the same text."""
        return {} if self.level else dict.fromkeys(self.picks(), 1)

    def text(self, path: str | None) -> str:
        """The blocks inside the containers with ``path``, or else with the page's own best path."""
        if path in self.paths and (found := self._inside(path)):
            return found
        return self._inside(next(iter(self.picks()), "body"))

    def _inside(self, path: str) -> str:
        number = self.paths.index(path)
        chosen: list[bool] = []
        for parent, _, own in self.nodes:
            chosen.append(own == number or (parent >= 0 and chosen[parent]))
        return "\n".join(text for node, text, _, _ in self.blocks if chosen[node])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(host, path, n) for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True)
                for path, n in Page(source.as_py()).votes().items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                               pa.array(cols[2], pa.int64())], names=["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(source.as_py()).text(path)
                 for source, path in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()),
                               pa.array([len(x) for x in texts], pa.int64()), b.column(3)],
                              names=["page_id", "url", "text", "n_chars", "path"])


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, votes)``: the winning container path of each host."""
    votes = _source(pages, id_col, url_col, html_col).select("host", "html").mapInArrow(
        _vote, "host string, path string, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = summed.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"))
    return best.select("host", "best.path", "best.votes")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, path)``, one row a page; ``path`` is the host's winner."""
    winners = write_table(host_paths(pages, id_col, url_col, html_col))
    joined = _source(pages, id_col, url_col, html_col).join(winners.select("host", "path"), "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, path string")
