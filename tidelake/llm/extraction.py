"""HTML extraction by consensus host paths.

A page is read into blocks of text, each with the path of its container, generalised to tag and class (digits dropped from
classes). Each page's containers are scored by the unlinked text of all blocks inside them; it votes for the
article or main that holds half of its text, or else for the smallest container that holds most of it, widened to a level-one
heading beside it; so leads, titles and sections of like weight stay together. Votes, weighed by text, are summed per host in Spark; every path with a fair share of
its host's votes wins there, so a host may have several templates. Pages are then read again and give the blocks
under the winning path that holds most of their text, the one of most votes among such; a page of none gives its own vote's.

Menus, headers, footers, asides, notices, adverts, forms, scripts, styles and reader comments are left out by tag, or by a class or id
all of whose parts mark such an element (`share-buttons` and `comments`, but not `related-work` or `no-sidebar`), wherever they stand but
on headers and headings inside an article, on inline elements, and inside paragraphs, pre and code, whose marked words are text (a highlighted
comment of a program, say); a form or an element left out by its words that holds the page's article is taken
back (see `_taken_back`).

A page of n characters is read in time and memory that grow with n, however deep or broken its markup: elements are numbered, paths are
interned by parent and label, and open elements are counted by name.

What stands outside the winning container isn't given, though it may be a part of the article (a section that follows the article element):
that is what the votes decide. Formulas (math), text of drawings and fallback text are text; titles and templates aren't.

Defined results: null and empty html give an empty text; a null url belongs to host ""; repeated rows are read each; of paths with equal
votes the shorter wins; markup that breaks off is read up to its end; very long pages are read whole; an empty table gives an empty
result. Only the named columns are read, so others may have any name.
"""
from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written
from .url_filters import url_parts

BROADCAST_ROWS = 200_000
_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog button head".split())
#: Words of a class or id that mark what is no part of an article.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead "
    "menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside those in one class or id and say no more than where or what kind of box it is.
BOX_WORDS = frozenset(
    "area bar block body bottom box btn button buttons container content bottom form global icons inner item items left link links list main outer "
    "page panel post posts primary right row secondary section site slot sticky text title top unit wrap wrapper".split())
#: Words of wrappers' layout; elements with others need an article or main heading inside to be taken back.
LAYOUT = frozenset("banner footer header masthead menu nav navbar navigation sidebar toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search".split())
HEADINGS = frozenset("header h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset("article main h1".split())
CONTAINER = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
_CLOSES_P = BLOCK - {"body", "html", "head"}
#: A new element of these ends an open one of its group, unless one of the group's scopes was opened since.
_GROUPS = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "dd": (("dd", "dt"), ("dl",))}
_GROUP_OF = {name: g for g, (own, _) in _GROUPS.items() for name in own}
_TRACKED = {name: [g for g, (own, scopes) in _GROUPS.items() if name in own or name in scopes] for own, scopes in _GROUPS.values() for name in (*own, *scopes)}
#: Share of a page's text that the voted container holds, and that a winning path must hold of a page to be used for it.
MOST, HELD = 0.8, 0.5
#: Share of its host's votes that a path needs to win.
FAIR = 0.05


def _left_out(tag: str, attributes: str, inside_article: bool, inside_text: bool) -> tuple[bool, bool, bool]:
    """Class words count on block elements, and not inside running text or code (inside_text), where they colour words. Whether an element is left out, whether it may be taken back, and so without an article or main heading inside."""
    if tag in LEFT_OUT or tag == "header" and not inside_article:
        return True, tag == "form", True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False, False, False
    found: set[str] = set()
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ROLES:
                return True, False, False
        elif tag in BLOCK and not inside_text and not (inside_article and tag in HEADINGS):
            for name in value.split():
                words = _WORD.findall(name)
                marks = LEFT_OUT_WORDS.intersection(words)
                if marks and all(w in LEFT_OUT_WORDS or w in BOX_WORDS for w in words):
                    found |= marks
    return bool(found), True, found <= LAYOUT


def _taken_back(parts: list[tuple[int, list[tuple[str, int, bool]]]], marks: list[int], left: list[tuple[int, bool, bool]]) -> set[int]:
    """Numbers of the left-out elements that hold the page's article: while no article, main or h1 stays, the outermost one with
    the most unlinked text (with an article, main or h1 first), if that is more than what stays. left has the number of the
    left-out element round each (-1: none) before it, and what _left_out says of it."""
    own, marked = [0] * (len(left) + 1), [False] * (len(left) + 1)  # the last is what stays
    for _, pieces in parts:
        for s, e, linked in pieces:
            own[e] += 0 if linked else len(s.strip())
    for e in marks:
        marked[e] = True
    has, size, inner = marked.copy(), own.copy(), defaultdict(list)
    for e in range(len(left) - 1, -1, -1):
        above = left[e][0]
        inner[above].append(e)
        if above >= 0:
            size[above] += size[e]
            has[above] |= has[e]
    back: set[int] = set()
    stays, done = own[-1], marked[-1]
    heap = [(not has[e], -size[e], e) for e in inner[-1]]
    heapify(heap)
    while heap and not done:
        e = heappop(heap)[2]
        if left[e][1] and size[e] > stays and (left[e][2] or has[e]):
            back.add(e)
            stays, done = stays + own[e], marked[e]
            for f in inner[e]:
                heappush(heap, (not has[f], -size[f], f))
    return back


def _label(tag: str, attributes: str) -> str:
    for m in _NAMED.finditer(attributes):
        if m[1].lower() == "class":
            names = sorted({_DIGITS.sub("", x).replace("/", "") for x in (m[2] or m[3] or m[4] or "").lower().split()} - {""})
            return ".".join([tag, *names])
    return tag


class Page:
    """The containers and blocks of one page.

    Elements that are containers have a number each, 0 for the page itself: parent, path (an interned number), tag. blocks: (container, text,
    characters of links). heads: containers in which an h1 stands."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path = [-1], [""], [0]
        self.labels: list[tuple[int, str]] = [(-1, "")]  # of each path: the path above and the last label
        self._known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self.heads: list[int] = []
        self._read(source)

    def path_of(self, path: int) -> str:
        """A path as text."""
        out = []
        while path > 0:
            path, label = self.labels[path]
            out.append(label)
        return "".join("/" + x for x in reversed(out))

    def _container(self, above: int, tag: str, label: str) -> int:
        key = (self.path[above], label)
        path = self._known.get(key)
        if path is None:
            path = self._known[key] = len(self.labels)
            self.labels.append(key)
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(path)
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        parts: list[tuple[int, list[tuple[str, int, bool]]]] = []
        text: list[tuple[str, int, bool]] = []  # with its innermost left-out element (or -1) and whether it is a link's
        left: list[tuple[int, bool, bool]] = []
        marks: list[int] = []
        # open elements: tag, container, innermost left-out element, place of the block element that was innermost before it
        stack: list[tuple[str, int, int, int]] = []
        opened: dict[str, int] = defaultdict(int)  # open elements by name
        inline: list[dict[str, int]] = [defaultdict(int)]  # open inline elements by name, since each open block element
        tracked: dict[str, list[int]] = {g: [] for g in _GROUPS}  # places in the stack of a group's elements and scopes
        block = -1  # place of the innermost open block element
        unclosed: set[str] = set()  # raw elements whose end doesn't come any more

        def end_block() -> None:
            if text:
                parts.append((stack[-1][1] if stack else 0, text.copy()))
                text.clear()

        def pop() -> None:
            nonlocal block
            name, _, _, outer = stack.pop()
            opened[name] -= 1
            if name in BLOCK:
                inline.pop()
                block = outer
            else:
                inline[-1][name] -= 1
            for g in _TRACKED.get(name, ()):
                tracked[g].pop()

        def close(place: int) -> None:
            end_block()
            while len(stack) > place:
                pop()

        def add(s: str) -> None:
            if s:
                text.append((s, stack[-1][2] if stack else -1, opened["a"] > 0))

        at, n = 0, len(page)
        while at < n:
            m = _OPEN.search(page, at)
            if m is None:
                add(page[at:])
                break
            add(page[at : m.start()])
            at = m.start()
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = n if stop < 0 else stop + 3
                continue
            if page[at + 1] in "!?":
                stop = page.find(">", at)
                at = n if stop < 0 else stop + 1
                continue
            tag = _TAG.match(page, at)
            if tag is None:  # quotes that don't close, or the page breaks off
                stop = page.find(">", at)
                if stop < 0:
                    break
                named = _NAME.match(page, at)
                closing, name, attributes, at = page[at + 1] == "/", named[1].lower() if named else "", "", stop + 1
            else:
                closing, name, attributes, at = bool(tag[1]), tag[2].lower(), tag[3], tag.end()
            if closing:
                if name in BLOCK:
                    if opened[name]:
                        place = block
                        while stack[place][0] != name:  # all passed are closed now
                            place = stack[place][3]
                        close(place)
                    elif name == "p":
                        end_block()
                elif inline[-1][name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in RAW and not attributes.endswith("/"):
                if name not in unclosed:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    if stop is not None:
                        at = stop.end()
                        continue
                    unclosed.add(name)
                if name in ("script", "style"):
                    at = n
                continue
            if name == "br":
                end_block()
                continue
            if name in _CLOSES_P:
                end_block()
                if block >= 0 and stack[block][0] == "p":
                    close(block)
                group = _GROUP_OF.get(name)
                if group and tracked[group] and stack[tracked[group][-1]][0] in _GROUPS[group][0]:
                    close(tracked[group][-1])
            if name in VOID or attributes.endswith("/") and name not in BLOCK:
                continue
            above = stack[-1] if stack else ("", 0, -1, -1)
            opened[name] += 1
            within, container = above[2], above[1]
            out_of, may, bare = _left_out(name, attributes, opened["article"] + opened["main"] > 0, opened["p"] + opened["pre"] + opened["code"] > 0)
            if out_of:
                left.append((within, may, bare))
                within = len(left) - 1
            if name in MARKS:
                marks.append(within)
                if name == "h1" and within < 0:
                    self.heads.append(container)
            if name in CONTAINER:
                container = self._container(container, name, _label(name, attributes))
            for g in _TRACKED.get(name, ()):
                tracked[g].append(len(stack))
            stack.append((name, container, within, block))
            if name in BLOCK:
                block = len(stack) - 1
                inline.append(defaultdict(int))
            else:
                inline[-1][name] += 1
        end_block()
        back = _taken_back(parts, marks, left) if any(may for _, may, _ in left) else set()
        for own, pieces in parts:
            kept = [(s, linked) for s, e, linked in pieces if e < 0 or e in back]
            joined = " ".join(entities.unescape("".join(s for s, _ in kept)).split())
            if joined:
                self.blocks.append((own, joined, min(sum(len(s) for s, linked in kept if linked), len(joined))))

    def held(self) -> list[int]:
        """Of each container, the unlinked characters of all blocks inside it."""
        size = [0] * len(self.tag)
        for c, text, links in self.blocks:
            size[c] += len(text) - links
        for c in range(len(size) - 1, 0, -1):
            size[self.parent[c]] += size[c]
        return size

    def best(self) -> int:
        """The container the page votes for: the outermost article, or else main, that holds HELD of the text; or else the smallest
        container that holds MOST of it, widened to the first level-one heading."""
        size = self.held()
        for name in ("article", "main"):
            for c, tag in enumerate(self.tag):  # containers stand in page order, outer ones first
                if tag == name and 0 < HELD * size[0] <= size[c]:
                    return c
        inner = [-1] * len(size)  # the child that holds most, the first of equals
        for c in range(1, len(size)):
            p = self.parent[c]
            if inner[p] < 0 or size[c] > size[inner[p]]:
                inner[p] = c
        chain = [0]
        while (c := inner[chain[-1]]) >= 0 and 0 < MOST * size[0] <= size[c]:
            chain.append(c)
        head, around = self.heads[0] if self.heads else -1, set(chain)
        while head > 0 and head not in around:
            head = self.parent[head]
        return head if head > 0 else chain[-1]

    def inside(self, chosen: set[int]) -> list[str]:
        """Texts of the blocks in containers of these numbers, or inside them."""
        into = [c in chosen for c in range(len(self.tag))]
        for c in range(1, len(into)):
            into[c] = into[c] or into[self.parent[c]]
        return [text for c, text, _ in self.blocks if into[c]]


def vote(page: str | None) -> tuple[str, int]:
    """(path, weight) of a page's vote; the weight is 0 without text."""
    read = Page(page or "")
    best = read.best()
    return read.path_of(read.path[best]), read.held()[best]


def text_under(page: str | None, paths: list[str]) -> str:
    """The page's blocks under the first of paths that holds HELD of its text, one a line; of none, under its own vote's container."""
    read = Page(page or "")
    if not read.blocks:
        return ""
    size = read.held()
    wanted = {p: i for i, p in enumerate(paths)}
    depth = {p.count("/") for p in paths}
    of: dict[int, set[int]] = defaultdict(set)
    level = [0] * len(read.labels)
    for i in range(1, len(read.labels)):
        level[i] = level[read.labels[i][0]] + 1
    rank = {i: wanted.get(read.path_of(i)) for i in range(len(read.labels)) if level[i] in depth}
    for c, path in enumerate(read.path):
        if rank.get(path) is not None:
            of[rank[path]].add(c)
    for i in sorted(of):
        if sum(size[c] for c in of[i]) >= HELD * size[0]:
            return "\n".join(read.inside(of[i]))
    best = read.best()
    return "\n".join(read.inside({c for c, p in enumerate(read.path) if p == read.path[best]}))


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the sum of the weights of all pages."""

    def run(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, weight = vote(page)
                if weight > 0:
                    hosts.append(host)
                    paths.append(path)
                    scores.append(weight)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "votes"])

    rows = pages.select(url_parts(F.col(url_col))[0].alias("host"), html_col).mapInArrow(run, "host string, path string, votes bigint")
    return rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(votes: DataFrame, fair: float = FAIR) -> DataFrame:
    """host, paths: those with at least `fair` of the host's votes (so at most 1 / fair), most votes first; of equals the shorter, then the first in order."""
    total = votes.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("total"))
    ranked = votes.join(total, F.col("host") == F.col("of")).where(F.col("votes") >= fair * F.col("total"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.length("path").alias("l"), "path")))
    return ranked.groupBy("host").agg(rows.alias("rows")).select("host", F.col("rows.path").alias("paths"))


def extract(pages: DataFrame, winners: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of each page. winners (host, paths) should be a written table: it is counted, and broadcast if small. Else hosts of many
    pages are broadcast and the pages of the others meet their host's paths by shuffle, so no task gets all pages of a large host."""
    few = winners.count() <= BROADCAST_ROWS
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), url_parts(F.col(url_col))[0].alias("host"))

    def run(batches):
        for batch in batches:
            texts = [text_under(page, paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    if few:
        met = rows.join(F.broadcast(winners), "host", "left")
    else:
        met = join_counted(rows, written(winners.join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host"), "host-paths"), ["host"])
    return met.select("_id", "_url", "_html", "paths").mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
