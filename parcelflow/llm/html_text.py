"""Main text of web pages: structure and a suffix array per host decide together.

A page becomes a stream of text blocks.  Blocks inside menus, footers, sidebars, adverts, forms, comments and the like
are boilerplate and go; names of classes and ids say so of parts of a page, rarely of elements of text (``_marked``).  The tokens of all other blocks of a page, joined, are its stream.  A stretch of ``min_tokens``
tokens, or a whole block of any length, is template when it is on enough distinct pages of its host: on ``min_pages``
pages, and on ``open_percent`` of the host's pages for tokens outside of article and main elements, on
``main_percent`` for those inside, where structure speaks for text.  What no template covers is the text.

Three steps find the stretches, each counting distinct pages.  From every ``min_tokens`` tokens in a row the window of
least hash is sampled, so pages that share a stretch share its samples; samples on too few pages leave.  Around the
others, the streams of a host are concatenated in each task and their suffixes sorted; groups of equal stretches go by
hash to the place where the pages of all tasks are added up.  The stretches on enough pages return to their pages.  A page
is in one task and counts once, so results do not depend on how pages are dealt to tasks or on ``shard_tokens``.
Pages of a host with equal streams count as one page: copies of an article say nothing about templates.

Defined results: null or empty html is the empty text; a null url is a host of its own; null ids and repeated rows are
treated like any other row, and repeated rows each have their row; other columns are ignored.  Whole texts of any length
are read; a stretch on exactly the least number or share of pages is template; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.scratch import materialize


@dataclass(frozen=True)
class Settings:
    min_tokens: int = 24
    min_pages: int = 3
    open_percent: int = 10
    main_percent: int = 30
    shard_tokens: int = 2_000_000  # sorted at once; results do not depend on it


# Elements of the HTML standard by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split()
)
_NEVER = frozenset("script style head title noscript template svg math iframe object canvas audio video textarea select button datalist".split())
_AROUND = frozenset("nav footer aside form menu dialog".split())
_PARAGRAPH_END = _BLOCK - {"body", "html"}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of class and id names that mark what is not the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices banner popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended comment comments commentlist disqus reply replies respond widget "
    "pagination pager toolbar skip".split()
)
# Words that mark an article element as a reader's comment; elements that hold text rather than parts of a page; lists.
_COMMENT = frozenset("comment comments commentlist reply replies respond disqus".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th".split())
_LISTS = frozenset("ul ol dl table".split())
_LAYOUT = frozenset("with has no without layout".split())
_SPLIT = re.compile(r"[^a-z]+")
_OPEN, _MAIN = 0, 1


def _names(attribute: str) -> set[str]:
    """Words of class and id names; a name like ``page-with-sidebar`` describes a layout and says nothing of its content."""
    words = [set(_SPLIT.split(name)) for name in attribute.lower().split()]
    return {w for own in words if own.isdisjoint(_LAYOUT) for w in own}


def _marked(tag: str, attribute: str, main: bool) -> bool:
    """Whether the names of an element mark it as boilerplate.

    Any word marks a part of a page; an element of text needs a name made of such words alone, an ``article`` one that
    begins with a word for comments; a list inside the article may be called a menu.
    """
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(_SPLIT.split(name)[0] in _COMMENT for name in attribute.lower().split())
    if tag in _TEXT:
        return any(words and words <= _NAMES for words in ({w for w in _SPLIT.split(name) if w} for name in attribute.lower().split()))
    names = _names(attribute) & _NAMES
    return bool(names - {"menu"} if main and tag in _LISTS else names)


class _Reader(HTMLParser):
    """Collects (role, text) of the blocks of a page that are not boilerplate.

    An open element holds which of the three states it begins: boilerplate, the article, or an inline element whose names
    mark it, in which text stays but blocks do not.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.begun = [0, 0, 0]  # open elements that begin each state
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.blocks: list[tuple[int, str]] = []

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((_MAIN if self.begun[1] else _OPEN, text))
            self.parts = []

    def _count(self, elements: list[tuple[str, bool, bool, bool]], by: int) -> None:
        for tag, *states in elements:
            self.open[tag] = self.open.get(tag, 0) + by
            for k, state in enumerate(states):
                self.begun[k] += by * state

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCK
        if block:
            self._end_block()
            if tag in _PARAGRAPH_END:
                self._close_paragraph()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in _VOID:
            return
        off = main = soft = False
        if not self.begun[0]:
            inside, role = self.begun[1] > 0, ""
            off = tag in _NEVER or tag in _AROUND or (tag == "header" and not inside) or (block and self.begun[2] > 0)
            if attrs:
                named = dict(attrs)
                role = (named.get("role") or "").lower()
                off = (
                    off
                    or role in _ROLES
                    or "hidden" in named
                    or named.get("aria-hidden") == "true"
                    or bool(re.search(r"display\s*:\s*none", named.get("style") or ""))
                )
                marked = _marked(tag, f"{named.get('class') or ''} {named.get('id') or ''}", inside)
                off, soft = off or (marked and (block or tag in _TEXT)), marked and not block and tag not in _TEXT
            main = tag in ("article", "main") or role == "main"
        self.stack.append((tag, off, main, soft))
        self._count(self.stack[-1:], 1)

    def _close_paragraph(self) -> None:
        """A block ends an open paragraph, as in the standard; boilerplate that began inside the paragraph goes on to its own end."""
        if not self.open.get("p"):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == "p":
                goes_on = next((j for j in range(k + 1, len(self.stack)) if self.stack[j][1] or self.stack[j][3]), len(self.stack))
                self._count(self.stack[k:goes_on], -1)
                del self.stack[k:goes_on]
                return
            if self.stack[k][0] in _BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_block()
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._count(self.stack[k:], -1)
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if not self.begun[0]:
            self.parts.append(data)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of the blocks of a page that are not boilerplate: 1 is inside the article, 0 is open."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._end_block()
    return reader.blocks


_PARSED = "uid long, page_id {id}, url string, host long, stream long, main array<boolean>, blocks array<string>"


def parse(pages: DataFrame) -> DataFrame:
    """Pages with the texts of their blocks, and which of them are in the article."""
    host = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    number = F.xxhash64(F.coalesce(F.lower(host), F.lit("")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), number.alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found = [blocks_of(html) for html in part.column(3).to_pylist()]
                uids = np.arange(uid, uid + len(part))
                uid += len(part)
                main = pa.array([[r == _MAIN for r, _ in f] for f in found], pa.list_(pa.bool_()))
                texts = pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))
                streams = np.array([xxhash.xxh64_intdigest("\n".join(t for _, t in f)) for f in found], np.uint64).view(np.int64)
                columns = [pa.array(uids, pa.int64()), *part.columns[:3], pa.array(streams), main, texts]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "page_id", "url", "host", "stream", "main", "blocks"])

    return rows.mapInArrow(run, _PARSED.format(id=pages.schema["page_id"].dataType.simpleString()))


def _copies(parsed: DataFrame) -> DataFrame:
    """Pages (copy) with the stream of a page of their host that comes before."""
    many = parsed.groupBy("host", "stream").agg(F.min("uid").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return parsed.select("uid", "host", "stream").join(many, ["host", "stream"]).filter("uid > kept").select(F.col("uid").alias("copy"))


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; with ``depth`` in the order of so many tokens at least."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(tokens), 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: n - step] = rank[step:] if step < n else behind[: n - step]
        order = np.lexsort((behind, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        step *= 2
        if new.all() or step >= n or (depth is not None and step >= depth):
            return order


class _Hashes(dict):
    """Hashes of tokens, as signed numbers."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` tokens."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ tokens[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _sample_size(settings: Settings) -> int:
    return max(1, settings.min_tokens // 3)


def samples(tokens: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the sampled windows: the least of each ``min_tokens`` tokens in a row."""
    size = _sample_size(settings)
    h, wide = _windows(tokens, size), settings.min_tokens - size + 1
    if len(h) < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(h, wide)
    at = np.unique(seen.argmin(axis=1) + np.arange(len(seen)))
    return h[at], at


def _stream(blocks: list[str]) -> tuple[list[str], np.ndarray]:
    """The tokens of a page, and the ends of its blocks."""
    words = [b.split(" ") for b in blocks]
    return [w for own in words for w in own], np.cumsum([len(own) for own in words], dtype=np.int64)


def _block_keys(blocks: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b, seed=1) for b in blocks], np.uint64).view(np.int64)


_COUNTS = "host long, key long, pages long"
_FLUSH = 1 << 20


def _counted(hosts: list[int], sizes: list[int], keys: list[np.ndarray], pages: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Keys of a host, with the pages they are on; each array of ``keys`` has those of one page without repeats."""
    host, key = np.repeat(np.array(hosts, np.int64), sizes), np.concatenate(keys)
    n = np.ones(len(key), np.int64) if pages is None else np.concatenate(pages)
    order = np.lexsort((key, host))
    host, key, n = host[order], key[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(host) != 0)]))
    columns = [host[starts], key[starts], np.add.reduceat(n, starts)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "key", "pages"])


def _common(counts: DataFrame, hosts: DataFrame, settings: Settings) -> DataFrame:
    """(host, key, outside, inside) of the keys that are template: in open blocks, and in articles."""
    n = counts.groupBy("host", "key").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= settings.min_pages)
    some = n.join(hosts, "host").filter(F.col("pages") * 100 >= F.col("total") * min(settings.open_percent, settings.main_percent))
    level = lambda percent: F.col("pages") * 100 >= F.col("total") * percent
    return some.select("host", "key", level(settings.open_percent).alias("outside"), level(settings.main_percent).alias("inside"))


def _sampled(parsed: DataFrame, settings: Settings) -> DataFrame:
    """Sampled windows and whole blocks with the number of pages they are on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hosts, keys = _Hashes(), [], []
        held = 0
        for batch in batches:
            for host, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blocks:
                    tokens = hashes.of(_stream(blocks)[0])
                    keys.append(np.unique(np.concatenate([samples(tokens, settings)[0], _block_keys(blocks)])))
                    hosts.append(host)
                    held += len(keys[-1])
                    if held >= _FLUSH:
                        yield _counted(hosts, [len(k) for k in keys], keys)
                        hosts, keys, held = [], [], 0
        if keys:
            yield _counted(hosts, [len(k) for k in keys], keys)

    return parsed.select("host", "blocks").mapInArrow(run, _COUNTS)


_FOUND = "uid long, host long, key long, at int, block boolean"


def _places(parsed: DataFrame, settings: Settings) -> DataFrame:
    """Sampled windows by their place in the page, and whole blocks by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows = []
                for uid, host, blocks in zip(*(c.to_pylist() for c in part.columns)):
                    if blocks:
                        h, at = samples(hashes.of(_stream(blocks)[0]), settings)
                        key = np.concatenate([h, _block_keys(blocks)])
                        at = np.concatenate([at, np.arange(len(blocks))])
                        whole = np.arange(len(key)) >= len(h)
                        rows.append((np.full(len(key), uid), np.full(len(key), host), key, at, whole))
                if rows:
                    uid, host, key, at, whole = (np.concatenate(c) for c in zip(*rows))
                    columns = [pa.array(uid, pa.int64()), pa.array(host, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(whole, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["uid", "host", "key", "at", "block"])

    return parsed.select("uid", "host", "blocks").mapInArrow(run, _FOUND)


_REGIONS = "uid long, host long, start int, text string"


def _regions(rows: DataFrame, settings: Settings) -> DataFrame:
    """The stretches of pages (uid, host, blocks, at) that can hold a template: what lies around common samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = settings.min_tokens - _sample_size(settings)
        for batch in batches:
            uids, hosts, starts, texts = [], [], [], []
            for uid, host, blocks, places in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = _stream(blocks)[0]
                spans: list[list[int]] = []
                for at in sorted(places):
                    low, high = max(0, at - reach), min(len(tokens), at + settings.min_tokens)
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = high
                    else:
                        spans.append([low, high])
                for low, high in spans:
                    uids.append(uid)
                    hosts.append(host)
                    starts.append(low)
                    texts.append(" ".join(tokens[low:high]))
            columns = [pa.array(uids, pa.int64()), pa.array(hosts, pa.int64()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "host", "start", "text"])

    return rows.select("uid", "host", "blocks", "at").mapInArrow(run, _REGIONS)


def shared(streams: list[list[str]], pages: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, place, distinct pages) of one of each group of equal stretches of ``size`` tokens; ``pages`` has the page of each stream."""
    sizes = np.array([len(s) for s in streams], np.int64)
    codes: dict[str, int] = {}
    flat, owner = [], np.repeat(np.arange(len(streams)), sizes + 1)
    for k, s in enumerate(streams):
        flat.extend(codes.setdefault(t, len(codes) + len(streams)) for t in s)
        flat.append(k)  # a token of its own ends every stream
    tokens, begins = np.array(flat, np.int64), np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(tokens, size)
    place = order - begins[owner[order]]
    order = order[place + size <= sizes[owner[order]]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    # Neighbours in the order share ``size`` tokens, or they start different stretches.
    same = np.ones(len(order) - 1, bool)
    for k in range(size):
        same &= tokens[order[:-1] + k] == tokens[order[1:] + k]
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    of = pages[owner[order]]
    once = np.lexsort((of, group))
    new = np.concatenate([[True], (np.diff(group[once]) != 0) | (np.diff(of[once]) != 0)])
    first = order[np.flatnonzero(np.concatenate([[True], ~same]))]
    return owner[first], first - begins[owner[first]], np.bincount(group[once][new])


def _stretches(regions: DataFrame, settings: Settings) -> DataFrame:
    """Stretches with the number of pages they are on, grouped by the suffix array of a host's regions in the task."""

    def counted(held: list[tuple[int, int, str]], hashes: _Hashes) -> Iterator[pa.RecordBatch]:
        of_host: dict[int, list[tuple[int, str]]] = {}
        for uid, host, text in held:
            of_host.setdefault(host, []).append((uid, text))
        for host, own in of_host.items():
            streams = [t.split(" ") for _, t in own]
            at, place, n = shared(streams, np.array([u for u, _ in own], np.int64), settings.min_tokens)
            if len(at):
                hashed = [_windows(hashes.of(s), settings.min_tokens) for s in streams]
                ends = np.cumsum([0] + [len(h) for h in hashed])
                keys = np.concatenate(hashed)[ends[at] + place]
                yield _counted([host], [len(keys)], [keys], [n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, last = _Hashes(), [], 0, None
        for batch in batches:
            for uid, host, text in zip(*(c.to_pylist() for c in batch.columns)):
                # The regions of a page follow each other and are counted together.
                if size >= settings.shard_tokens and uid != last:
                    yield from counted(held, hashes)
                    held, size = [], 0
                held.append((uid, host, text))
                size, last = size + text.count(" ") + 1, uid
        yield from counted(held, hashes)

    # Counted per task, so a page must not be cut by the split of a file: pages come whole from the shuffle by page.
    return regions.repartition("uid").sortWithinPartitions("uid").select("uid", "host", "text").mapInArrow(run, _COUNTS)


def _region_places(regions: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                uids, hosts, starts, texts = (c.to_pylist() for c in part.columns)
                keys = [_windows(hashes.of(t.split(" ")), settings.min_tokens) for t in texts]
                sizes = [len(h) for h in keys]
                at = [np.arange(s, s + n) for s, n in zip(starts, sizes)]
                columns = [np.repeat(np.array(c, np.int64), sizes) for c in (uids, hosts)] + [np.concatenate(keys), np.concatenate(at)] if keys else [[]] * 4
                columns = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(columns[0]), bool))], names=["uid", "host", "key", "at", "block"])

    return regions.select("uid", "host", "start", "text").mapInArrow(run, _FOUND)


def without_template(rows: DataFrame, settings: Settings) -> DataFrame:
    """(page_id, url, text) of pages with the places of their templates (null where there are none)."""

    def text_of(main: list[bool], blocks: list[str], marks: list[dict] | None) -> str:
        if not marks:
            return "\n\n".join(blocks)
        tokens, ends = _stream(blocks)
        inside = np.repeat(np.array(main, bool), np.diff(ends, prepend=0))
        gone = np.zeros(len(tokens), bool)
        for m in marks:
            low = int(ends[m["at"] - 1]) if m["block"] and m["at"] else 0 if m["block"] else m["at"]
            high = int(ends[m["at"]]) if m["block"] else m["at"] + settings.min_tokens
            where = inside[low:high]
            gone[low:high] |= (where & m["inside"]) | (~where & m["outside"])
        kept = [" ".join(t for t, g in zip(tokens[a:b], gone[a:b]) if not g) for a, b in zip([0, *ends[:-1]], ends)]
        return "\n\n".join(k for k in kept if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "main", "blocks", "marks").mapInArrow(run, f"page_id {kind}, url string, text string")


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    parsed = materialize(parse(pages), "html-parsed")
    copies = materialize(_copies(parsed), "html-copies")
    once = lambda rows: rows.join(copies, F.col("uid") == F.col("copy"), "left_anti")
    hosts = materialize(once(parsed.select("uid", "host")).groupBy("host").agg(F.count("*").alias("total")), "html-hosts")
    common = materialize(_common(_sampled(once(parsed.select("uid", "host", "blocks")), settings), hosts, settings), "html-common")
    found = materialize(_places(parsed, settings).join(common, ["host", "key"]), "html-found")
    around = found.filter("not block").groupBy("uid").agg(F.collect_list("at").alias("at"))
    regions = materialize(_regions(parsed.join(around, "uid"), settings), "html-regions")
    stretches = materialize(_common(_stretches(once(regions), settings), hosts, settings), "html-stretches")
    marks = found.filter("block").unionByName(_region_places(regions, settings).join(stretches, ["host", "key"]))
    marks = marks.groupBy("uid").agg(F.collect_list(F.struct("at", "block", "outside", "inside")).alias("marks"))
    out = without_template(parsed.join(materialize(marks, "html-marks"), "uid", "left"), settings)
    return out.withColumn("n_chars", F.length("text").cast("long"))
