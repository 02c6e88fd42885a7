"""Repeated passages by phrase automata: every word inside a window that already occurred is removed.

A window is ``window`` consecutive words of one document; it is a repeat when the same words start earlier, in a
document with a smaller id or further up in the same one.

1. Every window contains an anchor, the phrase of ``phrase`` words with the least hash, the same phrase wherever the window
   occurs.  Anchors that occur at least twice in all documents are confirmed as recurring (``blocks.recurring``).
2. Every block of documents is a shard: its recurring phrases are compiled into an Aho-Corasick automaton, and the documents
   of the block are streamed through it, which locates every occurrence.  Only windows around an occurrence
   can be repeats.
3. Those windows meet by a 96-bit hash: a block sends each of its distinct windows once, with its first place,
   a bucket names the blocks where it is not the first.
4. Every block removes what its repeated windows cover.

Texts move compressed and twice; windows that are unique in all documents are never shuffled.  A passage in a third of
all documents is one entry per block.

Defined results: a null or empty text has no words; a null id comes after all others; documents of one id are
ordered by block and place; repeated rows are documents like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B


@dataclass(frozen=True)
class Settings:
    window: int = 20
    phrase: int = 5
    block_bytes: int = B.BLOCK_BYTES


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_GAP = b"\n"  # stands between two documents; no word contains it
_SLOPE1, _SLOPE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Words:
    """The words of a block in one stream, with a gap behind every document."""

    def __init__(self, block: B.Block, window: int, lower: bool = False, hashed: bool = True) -> None:
        self.lists = [(t.lower() if lower else t).split() for t in block.texts()]
        self.sizes = np.array([len(w) for w in self.lists], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.stream = [w for words in self.lists for w in (*words, _GAP)]
        if hashed:
            hashes = _WordHashes()
            self.values = np.fromiter(map(hashes.__getitem__, self.stream), np.uint64, len(self.stream))
        # Windows that start in a document and end in it.
        self.valid = np.zeros(len(self.stream), bool)
        for a, n in zip(self.starts.tolist(), self.sizes.tolist()):
            self.valid[a : a + max(0, n - window + 1)] = True

    def rolled(self, width: int, slope: int) -> np.ndarray:
        """Hash of every ``width`` neighbouring words."""
        n = len(self.values) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = h * np.uint64(slope) + self.values[k : k + n]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def anchors(words: Words, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows, and the hash of each."""
    grams = words.rolled(settings.phrase, _SLOPE1)
    least = B.minimizers(grams, settings.window - settings.phrase + 1)
    places = np.unique(least[words.valid[: len(least)]])
    return places, grams[places]


def locate(words: Words, phrases: set[bytes], size: int) -> np.ndarray:
    """First word of every occurrence of the phrases, by one automaton over the whole stream."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(p.decode("latin-1"))
    automaton.make_automaton()
    text = (b" " + b" ".join(words.stream) + b" ").decode("latin-1")
    ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
    # A phrase ends with the space behind its last word.
    behind = np.cumsum(np.fromiter(map(len, words.stream), np.int64, len(words.stream)) + 1)
    return np.searchsorted(behind, ends) - (size - 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Ascending integers, as compressed differences."""
    flat = [np.diff(a.astype(np.int64), prepend=0).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(flat))


def unpacked(data: bytes, parts: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(parts, -1)
    return [np.cumsum(p) for p in flat]


_WINDOW = np.dtype([("high", "<u8"), ("low", "<u4")])
SENT = "bucket long, block long, windows binary, places binary"


def send_windows(number: int, places: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray, buckets: int) -> pd.DataFrame:
    """Windows of a block for the buckets: each distinct one once, at its first place; further places go along as repeats.

    ``places`` ascend, and ``ids`` (of the documents) with them.
    """
    _, first = np.unique(high, return_index=True)
    again = np.ones(len(places), bool)
    again[first] = False
    first.sort()
    entry = np.empty(len(first), _WINDOW)
    entry["high"], entry["low"] = high[first], low[first]
    bucket = B.split_keys(entry["high"], buckets)[0]
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    rows = [
        (int(b), number, entry[part].tobytes(), packed(places[first[part]], ids[first[part]]))
        for b, part in zip(found, np.split(order, starts[1:]))
        if len(part)
    ]
    if again.any():
        rows.append((number % buckets, number, b"", packed(places[again])))
    return pd.DataFrame(rows, columns=["bucket", "block", "windows", "places"])


def later_places(pdf: pd.DataFrame) -> list[tuple[int, bytes]]:
    """(block, places) of the windows of one bucket that are not the first of their kind, in order of id, block and place."""
    out = [(b, p) for b, w, p in zip(pdf["block"], pdf["windows"], pdf["places"]) if not w]
    own = pdf[pdf["windows"].str.len() > 0]
    if len(own):
        entries = [np.frombuffer(w, _WINDOW) for w in own["windows"]]
        sizes = [len(e) for e in entries]
        numbers = own["block"].to_numpy()
        row = np.repeat(np.arange(len(own)), sizes)
        where = [unpacked(p, 2) for p in own["places"]]
        place, ids = (np.concatenate([w[k] for w in where]) for k in (0, 1))
        flat = np.concatenate(entries)
        order = np.argsort(flat["high"], kind="stable")
        high = flat["high"][order]
        equal = np.zeros(len(high) + 1, bool)
        equal[1:-1] = high[1:] == high[:-1]
        # Only windows with a neighbour of the same hash need an order.
        some = order[equal[1:] | equal[:-1]]
        some = some[np.lexsort((place[some], numbers[row[some]], ids[some], flat["low"][some], flat["high"][some]))]
        later = np.zeros(len(some), bool)
        later[1:] = (flat["high"][some][1:] == flat["high"][some][:-1]) & (flat["low"][some][1:] == flat["low"][some][:-1])
        late = some[later]
        late = late[np.lexsort((place[late], row[late]))]
        found, starts = np.unique(row[late], return_index=True)
        out.extend((numbers[r], packed(place[part])) for r, part in zip(found, np.split(late, starts[1:])) if len(part))
    return out


def repeats(sent: DataFrame) -> DataFrame:
    """(block, places): the places of windows that are not the first of their kind, for all buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(later_places(pdf), columns=["block", "places"])

    return sent.groupBy("bucket").applyInPandas(run, "block long, places binary")


def covered(length: int, places: pd.Series, width: int) -> np.ndarray:
    """What the windows at the given places cover."""
    change = np.zeros(length + width + 1, np.int64)
    for p in places:
        at = unpacked(p, 1)[0]
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
    return np.cumsum(change)[:length] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by spaces)."""
    texts = B.pack(docs, id_col, text_col, settings.block_bytes)
    size, width = settings.phrase, settings.window
    buckets = B.buckets_for(texts, 0.03)
    window_buckets = B.buckets_for(texts, 0.16)

    def send(block: B.Block) -> pd.DataFrame:
        return B.sent(block.number, *B.distinct_keys(anchors(Words(block, width), settings)[1]), buckets)

    back = B.recurring(B.each_block(texts, send, B.SENT))

    def stream(block: B.Block, rows: pd.DataFrame) -> pd.DataFrame:
        words = Words(block, width)
        places, keys = anchors(words, settings)
        recurs = places[B.known(keys, rows, buckets)]
        phrases = {b" %b " % b" ".join(words.stream[p : p + size]) for p in recurs.tolist()}
        if not phrases:
            return pd.DataFrame(columns=["bucket", "block", "windows", "places"])
        found = locate(words, phrases, size)
        change = np.zeros(len(words.stream) + 1, np.int64)
        np.add.at(change, np.maximum(found - (width - size), 0), 1)
        np.add.at(change, found + 1, -1)
        near = np.flatnonzero((np.cumsum(change)[:-1] > 0) & words.valid)
        ids = block.ids[np.searchsorted(words.starts, near, side="right") - 1]
        high, low = words.rolled(width, _SLOPE1)[near], words.rolled(width, _SLOPE2)[near].astype(np.uint32)
        return send_windows(block.number, near, high, low, ids, window_buckets)

    late = repeats(B.by_block(texts, back, stream, SENT))

    def cut(block: B.Block, rows: pd.DataFrame) -> pd.DataFrame:
        words = Words(block, width, hashed=False)
        gone = covered(len(words.stream), rows["places"], width)
        removed, kept = [], []
        for a, own in zip(words.starts.tolist(), words.lists):
            mask = gone[a : a + len(own)]
            removed.append(int(mask.sum()))
            kept.append(b" ".join([w for w, m in zip(own, mask.tolist()) if not m] if removed[-1] else own))
        return pd.DataFrame(
            {
                "doc_id": B.as_series(block.ids),
                "n_words": words.sizes,
                "n_removed": removed,
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                "kept": [k.decode("utf-8", "replace") for k in kept],
            }
        )

    return B.by_block(texts, late, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
