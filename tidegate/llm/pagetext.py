"""Main text of web pages: markup names the article, a host's suffix array finds what its pages repeat.

A page is read once into blocks of text. Where markup names the article, its blocks are the text. What stands outside
is boilerplate by its markup, or undecided. The token streams of all blocks outside, page after page, are the
host's string: its suffixes are sorted over all tasks, and where neighbours begin with the same tokens on several distinct
pages, these tokens are covered. A block that is covered whole is boilerplate; unique runs stay, unless markup names them so.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm._scratch import written

#: Tokens of a repeated run, and distinct pages of the host that have it.
WINDOW, PAGES = 8, 3

#: Element names by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SPACES = frozenset("br td th img input".split())
#: Their content is no markup, or none of it is text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("template svg object audio video canvas map head datalist".split())
BOILERPLATE = frozenset("nav aside footer menu dialog form fieldset button select noscript search".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert status toolbar tablist form".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail footer colophon masthead topbar banner ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations trending popular comment comments disqus respond reply replies pagination pager toolbar widget skip paywall".split()
)
BEGINNINGS = ("comment", "sidebar", "cookie", "advert", "footer", "newsletter", "breadcrumb", "sponsor", "subscri")
ENDS = ("nav", "menu", "footer", "sidebar", "comments", "banner", "popup", "modal")
#: What only a page, not an article, has at its head.
PAGE_HEAD = ("header",)
CONTENT = frozenset("post entry story articlebody articletext entrycontent postcontent articlecontent maincontent postbody storybody content article".split())
EXEMPT = frozenset("html body article main".split())
#: An end tag is implied where one of the first begins inside an open one, up to the nearest of the last.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL)
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
_TELLING = re.compile(r"(?i)class|id|role|itemprop|style")
_SPECIAL = BOILERPLATE | HIDDEN | {"article", "main", "header"}
_AROUND_P = BLOCKS - {"p"} | {"td", "th", "button"}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

NONE, WEAK, STRONG = 0, 1, 2
#: How well markup names a block: marked as boilerplate, not at all, in a content element, in the main one, in an article.
MARKED, OPEN, INSIDE, MAIN, ARTICLE = -1, 0, 1, 2, 3


def _decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _words(names: str) -> Iterator[list[str]]:
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if parts and parts[0] not in ("has", "with", "no", "without"):
            yield parts


class Element(NamedTuple):
    name: str
    mark: int = NONE
    hidden: bool = False
    level: int = OPEN


@dataclass
class Page:
    """Blocks in page order: (text, level, name of the element that begins it)."""

    blocks: list[tuple[str, int, str]] = field(default_factory=list)

    @property
    def level(self) -> int:
        """How well markup names the best named block."""
        return max((level for _, level, _ in self.blocks), default=OPEN)

    def article(self) -> list[str]:
        """The blocks that markup names best, if it names any."""
        best = self.level
        return [text for text, level, _ in self.blocks if level == best] if best > OPEN else []

    def outside(self) -> list[tuple[str, int, str]]:
        best = self.level
        return [b for b in self.blocks if b[1] < best or best <= OPEN]


def _tells_boilerplate(part: str, ends: tuple[str, ...]) -> bool:
    return part in WORDS or part.startswith(BEGINNINGS) or part.endswith(ends)


def _element(name: str, attributes: dict[str, str], parent: Element) -> Element:
    mark, level = parent.mark, parent.level
    role = attributes.get("role", "").strip().lower()
    region = ARTICLE if name == "article" or role == "article" else MAIN if name == "main" or role == "main" else OPEN
    if region and mark == WEAK:
        mark = NONE  # a name like "with sidebar" around the article says nothing about it
    if name in BOILERPLATE:
        # some sites wrap the whole page in a form
        mark = max(mark, WEAK if name == "form" else STRONG)
    elif name == "header" and level < INSIDE or role in ROLES:
        mark = STRONG
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        mark = STRONG
    names = list(_words(attributes.get("class", ""))) + list(_words(attributes.get("id", "")))
    if name not in EXEMPT or region and any(w.startswith(("comment", "reply")) for parts in names for w in parts):
        ends = ENDS + PAGE_HEAD if level < INSIDE else ENDS
        if any(_tells_boilerplate(w, ends) for parts in names for w in parts):
            mark = max(mark, WEAK)
    content = any("".join(parts) in CONTENT for parts in names) or attributes.get("itemprop", "").lower() == "articlebody"
    return Element(name, mark, parent.hidden or name in HIDDEN, max(level, region, INSIDE if content and mark == NONE else OPEN))


def read(text: str) -> Page:
    """The blocks of a page. Tags that are never closed end with their parent or the page; raw text that never ends goes on to
    the page's end, like a comment."""
    page, stack, opened = Page(), [Element("")], {}
    main: list[str] = []
    aside: list[str] = []
    begun: list[tuple[int, str]] = []  # level and name at the first text of the main buffer

    def flush() -> None:
        if main:
            if begun:
                page.blocks.append((" ".join("".join(main).split()), *begun[0]))
                begun.clear()
            main.clear()
        if aside:
            if joined := " ".join("".join(aside).split()):
                page.blocks.append((joined, MARKED, stack[-1].name))
            aside.clear()

    def add(piece: str) -> None:
        top = stack[-1]
        if top.hidden or not piece:
            return
        if top.mark:
            aside.append(piece)
        else:
            if not begun and not piece.isspace():
                begun.append((top.level, top.name))
            main.append(piece)

    def pop_to(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop().name] -= 1

    def close(names: tuple[str, ...], scope: Collection[str] | None) -> None:
        """Ends the nearest open element of these names, unless one of the scope stands nearer."""
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return pop_to(i)
            if scope is not None and stack[i].name in scope:
                return None

    at, end = 0, text.rfind(">") + 1
    while (tag := text.find("<", at, end)) >= 0:
        while (m := _TAG.match(text, tag, end)) is None and (tag := text.find("<", tag + 1, end)) >= 0:
            pass
        if m is None:
            break
        if tag > at:
            add(_decoded(text[at:tag]))
        at = m.end()
        if m[0] == "<!--":
            ended = _COMMENT_END.search(text, at)
            at = ended.end() if ended else len(text)
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                flush()
            elif name in SPACES:
                add(" ")
            close((name,), None)
            continue
        if name in BLOCKS:
            flush()
            if opened.get("p"):
                close(("p",), _AROUND_P)
        elif name in SPACES:
            add(" ")
        if name in CLOSES:
            close(*CLOSES[name])
        if name in VOID:
            continue
        if name in RAW:
            ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            at = ended.end() if ended else len(text)
            continue
        given = m[3] or m[6]
        attributes = _attributes(given) if given and _TELLING.search(given) else None
        if attributes or name in _SPECIAL:
            stack.append(_element(name, attributes or {}, stack[-1]))
        elif name in BLOCKS or name in CLOSES or opened.get(name):
            stack.append(stack[-1]._replace(name=name))
        else:
            continue  # changes nothing, and its end finds nothing to end
        opened[name] = opened.get(name, 0) + 1
    rest = text[at:]
    # what begins like a tag and never ends is dropped, as browsers do
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    add(_decoded(rest[: cut.start()] if cut else rest))
    flush()
    return page


def host(url: str | None) -> str:
    """The host of a URL, in lower case, without user and port; empty where there is none."""
    m = re.match(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _stream(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the blocks outside the article, as 32-bit codes of an element's name and of words, and where blocks begin."""
    codes, starts = [], []
    for text, _, name in page.outside():
        starts.append(len(codes))
        codes.append(zlib.crc32(b"<" + name.encode("utf-8", "surrogatepass")))
        codes.extend(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split())
    return np.array(codes, ">u4"), np.array(starts, np.int32)


def _of(host_name: str, codes: np.ndarray) -> bytes | None:
    """A stream's name: equal streams of a host have the same."""
    if not len(codes):
        return None
    return hashlib.blake2b(host_name.encode("utf-8", "surrogatepass") + b"\0" + codes.tobytes(), digest_size=16).digest()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid, names, codes, starts = [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
            c, s = _stream(read(page.as_py() or ""))
            if len(c):
                h = host(url)
                sid.append(_of(h, c))
                names.append(hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                codes.append(c.tobytes())
                starts.append(s.tobytes())
        if sid:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (sid, names, codes, starts)], names=["sid", "host", "codes", "starts"])


def _suffixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, name, codes, n in zip(*(batch.column(c).to_pylist() for c in ("sid", "host", "codes", "n")), strict=True):
                c = np.frombuffer(codes, np.uint8).reshape(-1, 4)
                m = len(c) - window + 1
                if m < 1:
                    continue
                ahead = np.lib.stride_tricks.sliding_window_view(c, (window, 4)).reshape(m, 4 * window)
                key = np.hstack([np.broadcast_to(np.frombuffer(name, np.uint8), (m, 8)), ahead])
                width = key.shape[1]
                keys = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(key))])
                yield pa.RecordBatch.from_arrays([keys, pa.array([sid] * m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, n, np.int64))], names=["key", "sid", "pos", "n"])

    return run


_RUN = pa.schema([("key", pa.binary()), ("sid", pa.binary()), ("pos", pa.int32()), ("n", pa.int64())])


def _repeated(pages: int):
    """Suffixes in order, neighbours compared: those of a run of equal beginnings on enough distinct pages come out without key.
    A run that the task begins or ends with may go on in the next: its suffixes come out with their key, until it has
    enough pages on its own, which is at most a few streams' suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, enough = None, True, False
        seen: dict[bytes, int] = {}  # streams of the run, until there are enough pages
        held: list[tuple[bytes, int]] = []
        out: list[tuple[bytes | None, bytes, int, int]] = []

        def ended(edge: bool) -> None:
            nonlocal held
            if edge and key is not None:
                # one row a stream tells the neighbour task; a place of -1 stands for none
                out.extend((key, sid, -1, n) for sid, n in seen.items())
                out.extend((key, sid, pos, 0) for sid, pos in held)
            held = []

        for batch in batches:
            rows = zip(batch.column("key").to_pylist(), batch.column("sid").to_pylist(), batch.column("pos").to_pylist(), batch.column("n").to_pylist(), strict=True)
            for k, sid, pos, n in rows:
                if k != key:
                    ended(first)
                    first = first and key is None
                    key, enough, seen = k, False, {}
                if not enough:
                    seen[sid] = n
                    held.append((sid, pos))
                    if sum(seen.values()) >= pages:
                        enough = True
                        out.extend((None, *h, 0) for h in held)
                        held = []
                else:
                    out.append((None, sid, pos, 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RUN, strict=True)], schema=_RUN)
                out.clear()
        ended(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RUN, strict=True)], schema=_RUN)

    return run


def _covered(window: int):
    """Of each stream the numbers of the blocks that are covered whole, and how many words these have."""

    def run(t: pa.Table) -> pa.Table:
        pos = np.array(t.column("pos").to_pylist(), np.int64)
        codes, starts = t.column("codes")[0].as_py(), np.frombuffer(t.column("starts")[0].as_py(), np.int32)
        n = len(codes) // 4
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, pos, 1)
        np.add.at(change, pos + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        whole = np.logical_and.reduceat(covered, starts)
        words = np.diff(np.append(starts, n)) - 1
        return pa.table({"sid": t.column("sid").slice(0, 1), "covered": pa.array([np.flatnonzero(whole).tolist()], pa.list_(pa.int32())), "words": pa.array([int(words[whole].sum())], pa.int64())})

    return run


def repeated_blocks(pages: DataFrame, url: str = "url", html: str = "html", window: int = WINDOW, least: int = PAGES) -> DataFrame:
    """(sid, covered, words): of each distinct stream of a host the blocks that lie whole in runs of ``window`` tokens or more
    which at least ``least`` pages of the host have, by number, and how many words they have.

    Pages with equal streams are one stream with a count, before any suffix is made. Suffixes are sorted by range, not dealt by
    host, so a host with most of the pages takes as many tasks as it needs.
    """
    found = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(_streams, "sid binary, host binary, codes binary, starts binary")
    one = found.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("host", "codes", "starts")])
    streams = written(one, "streams")
    suffixes = streams.select("sid", "host", "codes", "n").mapInArrow(_suffixes(window), "key binary, sid binary, pos int, n long")
    placed = suffixes.repartitionByRange("key", "sid", "pos").sortWithinPartitions("key", "sid", "pos")
    runs = written(placed.mapInArrow(_repeated(least), "key binary, sid binary, pos int, n long"), "runs")
    edges = runs.where("key IS NOT NULL")
    # at most two runs a task, each of fewer pages than it takes
    enough = edges.where("pos < 0").groupBy("key", "sid").agg(F.max("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    places = runs.where("key IS NULL").select("sid", "pos").unionByName(edges.where("pos >= 0").join(enough, "key").select("sid", "pos"))
    return places.join(streams.select("sid", "codes", "starts"), "sid").groupBy("sid").applyInArrow(_covered(window), "sid binary, covered array<int>, words long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid, article, undecided, number = [], [], [], []
        for url, page in zip(batch.column("__url").to_pylist(), batch.column("html"), strict=True):
            p = read(page.as_py() or "")
            sid.append(_of(host(url), _stream(p)[0]))
            article.append(p.article())
            some = [(k, t) for k, (t, level, _) in enumerate(p.outside()) if level == OPEN] if p.level <= OPEN else []
            undecided.append([t for _, t in some])
            number.append([k for k, _ in some])
        made = [pa.array(sid, pa.binary()), pa.array(article, pa.list_(pa.string())), pa.array(undecided, pa.list_(pa.string())), pa.array(number, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__url"), *made], names=["__id", "__url", "sid", "article", "open", "number"])


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW, least: int = PAGES) -> DataFrame:
    """One row per row: the id, the URL, text, n_chars (code points) and n_repeated, the words outside the article that the
    host's pages repeat.

    The text is the blocks of the article that markup names, or else the blocks that neither markup nor the host's
    repetitions tell to be boilerplate: character references are decoded, white space within a block is one space, and
    blocks are joined by two line feeds. A null or empty page has an empty text, and so has one that is boilerplate
    alone. A null URL counts as the empty host. Repeated rows and null ids give a row each; two pages that are alike count as two where
    repetitions are counted. Other columns, whatever their names, are left out. An empty table gives an empty table.
    """
    flags = repeated_blocks(pages, url, html, window, least).select(F.col("sid").alias("__sid"), "covered", "words")
    source = pages.select(F.col(id).alias("__id"), F.col(url).alias("__url"), F.col(html).alias("html"))
    schema = source.drop("html").schema.add("sid", "binary")
    for name, kind in (("article", T.StringType()), ("open", T.StringType()), ("number", T.IntegerType())):
        schema = schema.add(name, T.ArrayType(kind))
    # pages with nothing outside the article have no stream: each gets a key of its own, so that they don't meet in one task
    key = F.coalesce("sid", F.to_binary(F.hex(F.xxhash64("__id", "__url")), F.lit("hex")))
    known = source.mapInArrow(_read, schema).withColumn("sid", key).join(flags, F.col("sid") == F.col("__sid"), "left")
    unique = F.filter("open", lambda _, i: ~F.coalesce(F.array_contains(F.col("covered"), F.get("number", i)), F.lit(False)))
    text: Column = F.array_join(F.concat("article", unique), "\n\n")
    out = known.select(F.col("__id").alias(id), F.col("__url").alias(url), text.alias("text"), F.coalesce("words", F.lit(0)).cast("long").alias("n_repeated"))
    return out.select(id, url, "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
