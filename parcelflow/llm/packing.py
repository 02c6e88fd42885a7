"""Packing documents into token sequences of a fixed length, in order, by dynamic programming.

The tokens of a partition's documents form one stream.  A sequence is a window of the stream; windows
end at document ends, sentence ends or, where neither is near, inside a sentence.  The cuts minimise
padding plus a penalty for every cut that truncates: with the cost of a window being ``length`` minus
its tokens, the best predecessor of a cut is the least ``cost + position`` among the cuts at most
``length`` before it, which a monotone queue yields in constant time per cut.  The rest at the end
of a partition is cut into sequences of power-of-two lengths, which need no padding, where that is cheaper.

Every partition is packed where it lies: no shuffle, and memory bounded by ``block_tokens`` and the
longest document.  Sequence ids are unique: partition number, then a counter.  Retried tasks read the same
rows of a written table and give the same ids.

Defined results: a null or empty text is the end token alone; null ids and repeated rows are packed like any
other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Penalties are in padding tokens."""

    length: int = 4096
    end_token: int = 2
    sentence_penalty: int = 4
    inside_penalty: int = 24
    inside_every: int = 64
    block_tokens: int = 1 << 20


class WordTokens:
    """Token ids of texts by way of their words, for a tokenizer of lower-case words that drops white space.

    Texts are cut at spaces and line ends, and before a full stop or comma behind a word, where the tokenizer cuts as well, so the ids
    of the words joined are the ids of the text. New words of letters are encoded many at a time, by the same merges
    without the steps that only whole texts need; all others go through the tokenizer as they are.
    """

    _KEEP = 400_000
    _PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|(?:(?!'(?:s|t|re|ve|m|ll|d))[^a-z0-9])(?:[^a-z0-9])*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        byte_level = [p for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        light = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}
        self.merges = Tokenizer.from_str(json.dumps({**described, "normalizer": None, "pre_tokenizer": light, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.stops = np.zeros(len(self.ends), bool)  # tokens that end a sentence
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
            core = token.removesuffix("</w>")
            self.stops[i] = bool(core) and not core.strip(".!?") and self.ends[i]
        self.words: dict[str, bytes] = {"": b""}

    def _one(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, words: list[str]) -> None:
        """Learn words that the tokenizer would not cut."""
        if not words:
            return
        ids = np.asarray(self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            self.words.update((w, self._one(w)) for w in words)
            return
        flat, start = ids.tobytes(), 0
        for word, stop in zip(words, cuts):
            self.words[word] = flat[start:stop]
            start = stop

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        # Words of ASCII letters, digits and marks fall into pieces as the tokenizer's own expression cuts them.
        cut = {w: self._PIECES.findall(w) for w in odd if w.isascii() and "<|" not in w}
        pieces = {p for parts in cut.values() for p in parts} - self.words.keys()
        self._many(list(pieces.union(plain)))
        for w in odd:
            parts = cut.get(w)
            self.words[w] = self._one(w) if parts is None else b"".join([self.words[p] for p in parts])

    def _split(self, text: str) -> list[str] | None:
        """Lower-case words; nothing where lower case depends on context or characters still have to be composed."""
        if not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)):
            return None
        text = text.lower().replace("\n", " ")
        for mark, apart in ((". ", " . "), (", ", " , ")):
            parts = text.split(mark)
            # A stop behind a mark belongs to one run with it.
            if all([p[-1:].isalnum() for p in parts[:-1]]):
                text = apart.join(parts)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for k in range(0, len(texts), 512):
            part = texts[k : k + 512]
            split = [self._split(t) for t in part]
            used = set()
            for s in split:
                used.update(s or ())
            if len(self.words) > self._KEEP:
                self.words = {"": b""}
            self._learn(used - self.words.keys())
            look = self.words.__getitem__
            out.extend(self._one(t) if s is None else b"".join(map(look, s)) for t, s in zip(part, split))
        return out


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of each; gaps between them are at most ``inside_every``."""
    at_stop = np.flatnonzero(stops[ids]) + 1
    places = np.union1d(at_stop, doc_ends)
    edges = np.concatenate([[0], places])
    wide = np.flatnonzero(np.diff(edges) > settings.inside_every)
    inside = [np.arange(edges[i] + settings.inside_every, edges[i + 1], settings.inside_every) for i in wide]
    extra = np.concatenate(inside) if inside else np.zeros(0, np.int64)
    places = np.union1d(places, extra)
    penalty = np.full(len(places), settings.sentence_penalty, np.int64)
    penalty[np.searchsorted(places, extra)] = settings.inside_penalty
    # The end token belongs to its sentence: a document's end costs nothing, just before it a whole sentence does.
    penalty[np.searchsorted(places, doc_ends)] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int, last: bool, inside_penalty: int) -> list[int]:
    """Cuts from 0 on with the least padding and penalties.

    With ``last`` the final cut is the last place; otherwise the path ends at the best place of the last window, and what
    is behind it waits for more.
    """
    at = [0, *places.tolist()]
    pen = [0, *penalty.tolist()]
    n = len(at)
    key = [0] * n  # cost so far plus position
    back = [-1] * n
    queue = deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + pen[j] + length
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    end = at[-1]
    tail: list[int] = []
    if last:
        # From every place of the last window: pad what is left, or cut it into powers of two.
        options, j = [], n - 1
        while j >= 0 and at[j] >= end - length:
            left = end - at[j]
            cost = key[j] - at[j]
            pieces = left.bit_count()
            options.append((cost + inside_penalty * max(0, pieces - 1), j, True))
            options.append((cost + (length - left if left else 0), j, False))
            j -= 1
        _, j, split = min(options)
        start = at[j]
        if split:
            for bit in range(length.bit_length(), -1, -1):
                if (end - start) >> bit & 1 and start < end:
                    start += 1 << bit
                    tail.append(start)
        elif start < end:
            tail = [end]
    else:
        j = max((j for j in range(n) if at[j] >= end - length), key=lambda j: (-key[j], at[j]))
    path = []
    while j > 0:
        path.append(at[j])
        j = back[j]
    return path[::-1] + tail


_PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Packer:
    """Packs a stream of documents; ``take`` returns the finished pieces as columns."""

    def __init__(self, stops: np.ndarray, settings: Settings, first_sequence: int) -> None:
        self.stops, self.settings, self.sequence = stops, settings, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # id, tokens of the document, tokens of it already packed
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.held += len(ids)

    def take(self, last: bool) -> tuple[list, np.ndarray]:
        settings = self.settings
        if not self.held:
            return [], np.zeros((0, len(_NAMES)), np.int64)
        ids = np.concatenate(self.ids)
        sizes = np.array([n - done for _, n, done in self.docs], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        places, penalty = boundaries(ids, ends, self.stops, settings)
        cuts = np.array(best_cuts(places, penalty, settings.length, last, settings.inside_penalty), np.int64)
        done = int(cuts[-1]) if len(cuts) else 0
        edges = np.union1d(np.concatenate([[0], cuts]), starts[starts < done])
        edges = edges[edges < done]
        stop = np.append(edges[1:], done)
        doc = np.searchsorted(ends, edges, side="right")
        window = np.searchsorted(cuts, edges, side="right")
        opened = np.concatenate([[0], cuts])[window]
        whole = np.array([n for _, n, _ in self.docs], np.int64)[doc]
        packed = np.array([d for _, _, d in self.docs], np.int64)[doc]
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges.tolist(), stop.tolist())]
        rows = np.column_stack([edges - starts[doc] + packed, stop - edges, crc, whole, window + self.sequence, edges - opened]).astype(np.int64)
        names = [self.docs[i][0] for i in doc.tolist()]
        self.sequence += len(cuts)
        first = int(np.searchsorted(ends, done, side="right"))
        rest = self.docs[first:]
        if rest:
            name, n, before = rest[0]
            rest[0] = (name, n, before + done - int(starts[first]))
        self.docs, self.ids, self.held = rest, [ids[done:].copy()], len(ids) - done
        return names, rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per piece of a document in a sequence. ``tokenizer`` is a file that every executor can read."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens(tokenizer)
        packer = _Packer(encoder.stops, settings, TaskContext.get().partitionId() << 32)
        end = np.array([settings.end_token], "<u4").tobytes()

        def rows(last: bool, like: pa.DataType) -> pa.RecordBatch:
            names, table = packer.take(last)
            columns = [pa.array(table[:, k], pa.int64()) for k in range(len(_NAMES))]
            return pa.RecordBatch.from_arrays([pa.array(names, like), *columns], names=["doc_id", *_NAMES])

        like = None
        for batch in batches:
            like = batch.column(0).type
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for name, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    packer.add(name, np.frombuffer(ids + end, "<u4"))
                    if packer.held >= settings.block_tokens:
                        yield rows(False, like)
        if like is not None:
            yield rows(True, like)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _PIECE.format(id=id_type.simpleString()))
