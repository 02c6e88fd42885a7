"""Benchmark decontamination by spaced seeds.

A seed is a window of words seen through a mask that ignores fixed positions, so a window with substituted
words still meets its original through one of the masks.  The seeds of the benchmark and of the documents
are joined on their hash; around every hit the item is laid over the document, and the stretch of
agreeing words, bridging substitutions, decides.

The benchmark is the small side: it is taken in blocks of bounded size, each block travels to the
documents, and the documents are read where they lie, without a shuffle.  A larger benchmark is more blocks.

Words are runs of letters and digits, in lower case.  An item counts as found when the stretch has
``min_matched`` agreeing words, or for shorter items ``short_percent`` of them.  An item of up to ``short_words`` words
is found as well when ``short_percent`` of all its words agree in place, wherever the others are: its words are dealt to
one spaced seed more than words may differ, so one seed is always whole and none is missed.  Items of 1 to 4
words are found when all their words agree; ``min_item_words`` leaves out shorter items where a caller asks for that.

Defined results: null and empty texts hold nothing; null ids are reported as null; repeated rows and items are
reported one by one; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """Masks of one span; a 1 is a position that counts."""

    masks: tuple[str, ...] = ("111101111000", "110110101101", "101011011011", "111111110000")
    min_item_words: int = 1
    min_matched: int = 13
    short_percent: int = 80
    short_words: int = 24
    mismatch_cost: int = 2
    drop: int = 8
    block_bytes: int = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(values: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of every window of ``values`` under the mask."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ values[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
    return h


def short_seeds(n: int, needed: int) -> list[tuple[str, int]]:
    """(mask, position) of seeds of an item of ``n`` words, one of which is whole whenever ``needed`` words agree."""
    if (n, needed) == (5, 4):
        return [(mask, 0) for mask in ("10101", "11010", "01011")]  # three words each instead of two
    step = n - needed + 1
    mask = ("1" + "0" * (step - 1)) * (n // step - 1) + "1"
    return [(mask, at) for at in range(step)]


_HITS = 1 << 14


class Finder:
    """Seeds of one block of the benchmark."""

    _BITS = 22

    def __init__(self, items: list[tuple[object, str | None]], settings: Settings) -> None:
        self.settings, self.codes, self.items = settings, {}, []
        self.names = []
        for name, text in items:
            words = _WORD.findall((text or "").lower())
            if len(words) >= settings.min_item_words:
                self.names.append(name)
                self.items.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], np.int64))
        self.masks = settings.masks
        self.values = _mix(np.arange(len(self.codes) + 2, dtype=np.uint64))
        found, where = [], []
        for m, mask in enumerate(self.masks):
            for i, item in enumerate(self.items):
                h = seeds(self.values[item], mask, m)
                found.append(h)
                where.append(np.column_stack([np.full(len(h), i), np.arange(len(h))]))
        self.hashes, self.where, self.some = self._table(found, where)
        # Short items: masks shared by many lengths, and where each is laid in the item.
        self.short_masks: dict[str, int] = {}
        self.words = np.full((len(self.items), settings.short_words), -1, np.int64)
        found, where = [], []
        for i, item in enumerate(self.items):
            if len(item) <= settings.short_words:
                self.words[i, : len(item)] = item
                for mask, at in short_seeds(len(item), self.whole(i)):
                    m = self.short_masks.setdefault(mask, len(settings.masks) + len(self.short_masks))
                    found.append(seeds(self.values[item[at : at + len(mask)]], mask, m))
                    where.append(np.array([[i, at]]))
        self.short_hashes, self.short_where, self.short_some = self._table(found, where)
        self.short_needed = np.array([self.whole(i) for i in range(len(self.items))], np.int64)

    def _table(self, found: list[np.ndarray], where: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, their (item, position), and which leading bits they have."""
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        places = np.concatenate(where).astype(np.int64) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(hashes, kind="stable")
        some = np.zeros(1 << self._BITS, bool)
        some[hashes >> np.uint64(64 - self._BITS)] = True
        return hashes[order], places[order], some

    def short_hits(self, stream: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, agreeing words, words spanned, position) of the short items of which enough words agree in place."""
        values, out = self.values[stream], []
        for mask, m in self.short_masks.items():
            h = seeds(values, mask, m)
            at = np.flatnonzero(self.short_some[h >> np.uint64(64 - self._BITS)])
            low, high = (np.searchsorted(self.short_hashes, h[at], side=s) for s in ("left", "right"))
            ends = np.cumsum(high - low)
            for k in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                hit = np.arange(k, min(k + _HITS, int(ends[-1])))
                seed = np.searchsorted(ends, hit, side="right")
                item, offset = self.short_where[high[seed] - ends[seed] + hit].T
                begin = at[seed] - offset
                doc = np.searchsorted(starts, at[seed] + mask.index("1"), side="right") - 1
                same = stream[begin[:, None] + np.arange(self.words.shape[1])] == self.words[item]
                agree = same.sum(axis=1)
                for j in np.flatnonzero(agree >= self.short_needed[item]).tolist():
                    places = np.flatnonzero(same[j])
                    first, last = int(places[0]), int(places[-1])
                    out.append((int(doc[j]), int(item[j]), int(agree[j]), last + 1 - first, int(begin[j] + first - starts[doc[j]])))
        return out

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, position of the item's start) of every seed that document and item share."""
        values, found = self.values[codes], set()
        for m, mask in enumerate(self.masks):
            h = seeds(values, mask, m)
            at = np.flatnonzero(self.some[h >> np.uint64(64 - self._BITS)])
            low, high = (np.searchsorted(self.hashes, h[at], side=s) for s in ("left", "right"))
            at, low, high = at[high > low], low[high > low], high[high > low]
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p, a, b in zip(doc.tolist(), (at - starts[doc]).tolist(), low.tolist(), high.tolist()):
                found.update((d, i, p - q) for i, q in self.where[a:b].tolist())
        return found

    def overlap(self, codes: np.ndarray, i: int, start: int) -> tuple[int, int, int]:
        """Best stretch of the item laid at ``start``: agreeing words, words spanned, position in the document."""
        item = self.items[i]
        a, b = max(0, -start), min(len(item), len(codes) - start)
        same = codes[start + a : start + b] == item[a:b]
        best, run, matched, first = (0, 0, 0, 0), 0, 0, 0
        for k, s in enumerate(same.tolist()):
            if run <= 0:
                run, matched, first = 0, 0, k
            run += 1 if s else -self.settings.mismatch_cost
            matched += s
            if run > best[0]:
                best = (run, matched, k + 1 - first, start + a + first)
        return best[1:]

    def needed(self, i: int) -> int:
        n = len(self.items[i])
        return min(self.settings.min_matched, -(-n * self.settings.short_percent // 100))

    def whole(self, i: int) -> int:
        """Agreeing words that a short item needs."""
        return -(-len(self.items[i]) * self.settings.short_percent // 100)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, position, agreeing words, words spanned): the best stretch of each item in each text."""
        # An item laid at the edge of a text must not reach the next text.
        get, gap = self.codes.get, max(self.settings.short_words, len(max(self.masks, key=len)))
        docs = [np.fromiter((get(w, 0) for w in _WORD.findall((t or "").lower())), np.int64) for t in texts]
        if not self.items or not docs:
            return []
        blank = np.full(gap, len(self.codes) + 1, np.int64)
        starts = np.cumsum([gap] + [len(d) + gap for d in docs[:-1]])
        stream = np.concatenate([blank, *(x for d in docs for x in (d, blank))])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, i, at in self.hits(stream, starts):
            matched, span, where = self.overlap(docs[k], i, at)
            if matched >= self.needed(i):
                best[k, i] = max(best.get((k, i), (0, 0, 0)), (matched, -span, -where))
        for k, i, matched, span, where in self.short_hits(stream, starts):
            best[k, i] = max(best.get((k, i), (0, 0, 0)), (matched, -span, -where))
        return [(k, i, -w, m, -s) for (k, i), (m, s, w) in sorted(best.items())]


def finders(benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "item_id", text_col: str = "text") -> Iterator[Finder]:
    """The benchmark in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // settings.block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield Finder([(r["id"], r["text"]) for r in part.collect()], settings)


_STEP = 256


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and item found in it; documents without any have no row."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_type}, item_id {item_type}, start_word long, n_matched long, n_spanned long, item_words long"

    def searched(finder: Finder) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), _STEP):
                    part = batch.slice(k, _STEP)
                    found = finder.search(part.column(1).to_pylist())
                    ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    numbers = [pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4)]
                    words = pa.array([len(finder.items[f[1]]) for f in found], pa.int64())
                    items = pa.array([finder.names[f[1]] for f in found])
                    items = items.cast(pa.int64()) if not found else items
                    yield pa.RecordBatch.from_arrays([ids, items, *numbers, words], names=["doc_id", "item_id", "start_word", "n_matched", "n_spanned", "item_words"])

        return texts.mapInArrow(run, schema)

    out = None
    for finder in finders(benchmark, settings):
        part = searched(finder)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found, with all their columns."""

    def filtered(rows: DataFrame, finder: Finder) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                keep = np.ones(len(batch), bool)
                for k in range(0, len(batch), _STEP):
                    for found in finder.search(texts[k : k + _STEP]):
                        keep[k + found[0]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    for finder in finders(benchmark, settings):
        docs = filtered(docs, finder)
    return docs
