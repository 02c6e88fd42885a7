"""Periodic runs of words: stretches in which a few words come round four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that has at least
``min_length`` words and ``min_repeats`` periods, and that neither neighbouring word extends.

1. Recursive frequency splitting.  A word of a run occurs ``min_repeats`` times in it, so a word that is rarer than that within its
   segment joins no run there: it splits the segment, the parts are counted anew, and so on until nothing splits
   or a part is too short.  The segments of many documents are counted together, by numpy.
2. Lag scan of the segments that are left.  Lags go in scales (k/2, k]; a run with such a period holds a multiple of k (counted from the
   segment's start) from which on k/2 + 4 words agree with those q later, so only those words are compared with all lags
   of the scale.  That is half a comparison per word and scale.  What agrees is extended to both sides;
   what lies inside a run of a smaller period is that run once more and is passed over.

Splitting only prunes: it stops when it has looked at every word ``patience`` times on average, which odd texts alone reach, and the
lag scan finds the same runs in what is left.  Memory follows the longest text of a slice of ``slice_bytes``.  There is no
shuffle: a document is the unit, hot sources or copies make no task larger.

Defined results: a null text has no words and no runs; a null id is kept as null; an empty table gives an empty result;
repeated rows are judged one by one; texts are never cut; runs are in order of start, then period; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """``min_repeats`` is 3 at least; ``patience`` bounds the work of splitting, not its result."""

    min_length: int = 6
    min_repeats: int = 4
    patience: int = 64
    slice_bytes: int = 4 << 20
    slice_docs: int = 512

    def least(self, period):
        return np.maximum(self.min_length, self.min_repeats * period)

    def agreeing(self, scale: int) -> int:
        """Words behind a multiple of ``scale`` that agree at every lag in (scale/2, scale] of a run."""
        lags = np.arange(scale // 2 + 1, scale + 1)
        return int((self.least(lags) - lags).min()) - scale + 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def segments(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what frequency splitting leaves of the stretches; their words are numbered apart."""
    stable, left, first = [], settings.patience * len(words), True
    while True:
        long = hi - lo >= settings.min_length
        lo, hi = lo[long], hi[long]
        sizes = hi - lo
        left -= int(sizes.sum())
        if len(lo) == 0 or left < 0:
            break
        places, owner = _ranges(lo, sizes), np.repeat(np.arange(len(lo)), sizes)
        if first:  # a number stands for a word of one document
            often = np.bincount(words)[words[places]] >= settings.min_repeats
        else:
            _, back, counts = np.unique(owner * (int(words.max()) + 1) + words[places], return_inverse=True, return_counts=True)
            often = counts[back] >= settings.min_repeats
        first = False
        whole = np.bincount(owner, often, len(lo)).astype(np.int64) == sizes
        stable.append((lo[whole], hi[whole]))
        open_ = often & ~whole[owner]
        before = np.concatenate([[False], open_[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]])
        behind = np.concatenate([open_[1:], [False]]) & np.concatenate([owner[1:] == owner[:-1], [False]])
        lo, hi = places[open_ & ~before], places[open_ & ~behind] + 1
    stable.append((lo, hi))
    lo, hi = (np.concatenate(x) for x in zip(*stable))
    order = np.argsort(lo)
    return lo[order], hi[order]


def _behind(w: np.ndarray, x: int, lag: int) -> int:
    """First place from ``x`` on whose word differs from that ``lag`` later; a separator ends the search."""
    step = 32
    while True:
        differ = w[x : x + step] != w[x + lag : x + lag + step]
        if differ.any():
            return x + int(differ.argmax())
        x, step = x + step, step * 2


def _before(w: np.ndarray, x: int, lag: int) -> int:
    """First place of the stretch up to ``x`` whose words agree with those ``lag`` later."""
    step = 32
    while True:
        a = max(0, x - step)
        differ = (w[a:x] != w[a + lag : x + lag])[::-1]
        if differ.any():
            return x - int(differ.argmax())
        x, step = a, step * 2


def lag_scan(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, settings: Settings, cells: int = 1 << 20) -> np.ndarray:
    """Rows (start, length, period) of all runs inside of the segments, none of which crosses an end."""
    if len(lo) == 0:
        return np.zeros((0, 3), np.int64)
    sizes = hi - lo
    widest = int(sizes.max())
    # Segments behind each other; a separator, equal to nothing else, before each and behind the last, and room for lags.
    starts = np.cumsum(sizes + 1) - sizes
    w = np.empty(int(starts[-1] + sizes[-1]) + 2 * widest + 80, np.int64)
    w[:] = -1 - np.arange(len(w))
    w[_ranges(starts, sizes)] = words[_ranges(lo, sizes)]

    found: list[tuple[int, int, int]] = []
    scale = 1
    while settings.least(scale // 2 + 1) <= widest:
        agreeing = settings.agreeing(scale)
        lags = np.arange(scale // 2 + 1, scale + 1)
        room = sizes - int(lags[0]) - agreeing
        held = np.flatnonzero(room >= 0)
        anchors = _ranges(np.zeros(len(held), np.int64), room[held] // scale + 1)
        anchors = anchors * scale + np.repeat(starts[held], room[held] // scale + 1)
        xs, qs = [], []
        rows = max(1, cells // len(lags))
        for k in range(0, len(anchors), rows):
            x = anchors[k : k + rows]
            a, b = np.nonzero(w[x[:, None] + lags[None, :]] == w[x][:, None])
            x, q = x[a], lags[b]
            for i in range(1, min(agreeing, 12)):
                same = w[x + i] == w[x + q + i]
                x, q = x[same], q[same]
            xs.append(x)
            qs.append(q)
        x, q = np.concatenate(xs), np.concatenate(qs)
        if found and len(x):
            # Two runs with periods p < q share fewer than p + q - 1 words, so what reaches further is no run of a larger period.
            smaller = np.array(sorted(found))
            reach = np.maximum.accumulate(smaller[:, 0] + smaller[:, 1] - smaller[:, 2] + 1)
            at = np.searchsorted(smaller[:, 0], x, "right") - 1
            open_ = (at < 0) | (reach[np.maximum(at, 0)] < x + q)
            x, q = x[open_], q[open_]
        new = []
        for lag in np.unique(q).tolist():
            own, k = np.sort(x[q == lag]), 0
            while k < len(own):
                x0 = int(own[k])
                stop = _behind(w, x0, lag)
                if stop >= x0 + agreeing:
                    s = _before(w, x0, lag)
                    if stop + lag - s >= settings.least(lag):
                        new.append((s, stop + lag - s, lag))
                k = max(k + 1, int(np.searchsorted(own, stop)))
        found += new
        scale *= 2
    runs = np.array(found, np.int64).reshape(-1, 3)
    at = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] += lo[at] - starts[at] if len(runs) else 0
    return runs


def runs_of(texts: list[list[bytes]], settings: Settings = Settings()) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    number, sizes = count(), np.array([len(t) for t in texts], np.int64)
    words = np.empty(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist()):
        own = defaultdict(number.__next__)
        words[a:b] = np.fromiter(map(own.__getitem__, t), np.int64, b - a)
    runs = lag_scan(words, *segments(words, ends - sizes, ends, settings), settings)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(ends, runs[:, 0], "right")
    runs[:, 0] -= (ends - sizes)[owner] if len(runs) else 0
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if len(runs) == 0:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(depth).tolist()) if d == 0]


_MADE = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period of each) and kept, the words left joined by a space."""

    def made(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts, settings)
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), parts),
            pa.array([b" ".join(collapsed(t, r)) for t, r in zip(texts, runs)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for k in range(len(batch)):
                text = batch.column(1)[k].as_py() or b""
                ids.append(batch.column(0)[k].as_py())
                texts.append(text.split())
                held += len(text)
                if held >= settings.slice_bytes or len(ids) == settings.slice_docs:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield made(ids, texts)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, _MADE).withColumn("kept", F.col("kept").cast("string"))


def longest(runs: Column) -> Column:
    """The run of the greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    order = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(order)
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The runs of every document as counts and digests: n_runs, the longest run, and SHA-256 of all runs and of the words left."""
    t = find_runs(docs, id_col, text_col, settings).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return t.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text, by a checksum of the id, with its words from one place on repeating the first few of them.

    With h the CRC-32 of the id in decimal digits and g = h div 10, texts with h % 10 = 0 and n > 0 words are changed: each word i >= a
    becomes word a + (i - a) % p, a = g % n and p = 1 + (n - a) div (3 + g % 8).  Texts without an id stay.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")

    def repeated(v: Column) -> Column:
        def placed(x: Column) -> Column:
            a, p, n = x["a"], x["p"], F.size(v)
            tail = F.transform(F.slice(v, a + 1, n - a), lambda w, i: F.get(v, (a + i % p).cast("int")))
            return F.array_join(F.concat(F.slice(v, 1, a), tail), " ")

        g = (h / 10).cast("long")
        n = F.size(v)
        a = (g % n).cast("int")
        x = F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int").alias("p"))
        return F.when(n > 0, F.element_at(F.transform(F.array(x), placed), 1)).otherwise(F.lit(""))

    tailed = F.element_at(F.transform(F.array(words), repeated), 1)
    return t.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), tailed).otherwise(F.col("text")).alias("text"))
