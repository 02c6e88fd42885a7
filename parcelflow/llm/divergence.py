"""Divergence of sources: how far the word shares of the sources of a language lie apart, pair by pair and term by term.

Every language keeps the terms of at least ``min_docs`` of its documents (V of them).  In a source with N occurrences of kept terms
a term with c of them has the share p = 1 + floor(scale * (c + 1) / (N + V)); two shares differ by floor((p - q)^2 / q).

The sum over all terms is taken in three parts, so that no pair of sources is looked at for terms that neither or one of them has:

1. what the pair would have if no term occurred in either: one product per pair;
2. for the terms of one source, the difference to part 1 if the other one had none: per distinct share of the source, with its number of terms;
3. corrections for the terms of both, by a frequent-pattern tree.  A term is the row of its nonzero counts in the order of
   sources; equal rows are one with a multiplicity.  Sorted rows are inserted into a tree, where rows with the same beginning share a path,
   and a node meets each of its ancestors once, for all the terms that pass through it.

Rows are dealt by ranges of their beginnings, so rows that share a path lie together; a task builds one tree per batch of rows, and trees just add up.
Counting merges in the tasks before anything is shuffled: a hot source or word is a few rows per task.  Written
tables stand between the steps.  A term's row has an entry per source, and the result a row per pair of sources, so sources should be
thousands, not millions.

All arithmetic is exact: shares by long division of integers, sums as decimals.  Totals per group have to stay below 9 * 10^15.

Defined results: a null text, language or source is an empty one; a text without terms still makes its group occur; repeated rows are
documents like any other; ids do not matter; a language without kept terms has pairs of value 0; a language with one source has no
pair; equal values rank in order of the item's UTF-8 bytes; texts are never cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.scratch import materialize


@dataclass(frozen=True)
class Settings:
    min_docs: int = 3
    top_terms: int = 200
    flush: int = 400_000  # entries that a task merges before it sends them
    often: int = 16  # documents of a term that stays with the task when others are sent
    combinations: int = 1 << 20  # of nodes and ancestors looked at together


# ASCII letters, the upper ones as lower ones, and all bytes of other characters; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


_COUNTED = "lang string, source string, term string, n long, docs long"


class Merged:
    """Counts of a task: occurrences and documents of the terms of each group."""

    def __init__(self) -> None:
        self.groups: dict[tuple, tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple, text: bytes) -> None:
        if group not in self.groups:
            self.groups[group] = Counter(), Counter()
        n, docs = self.groups[group]
        terms, before = terms_of(text), len(n)
        n.update(terms)
        docs.update(set(terms))
        self.held += len(n) - before

    def sent(self, often: int | None = None) -> pa.RecordBatch:
        """The counts, which are forgotten; with ``often`` terms of so many documents stay."""
        columns: list[list] = [[], [], [], [], []]
        self.held = 0
        for (lang, source), (n, docs) in list(self.groups.items()):
            gone = [t for t, d in docs.items() if often is None or d < often]
            for c, values in zip(columns, ([lang] * len(gone), [source] * len(gone), [t.decode() for t in gone], [n[t] for t in gone], [docs[t] for t in gone])):
                c += values
            if len(gone) == len(n):
                del self.groups[lang, source]
            else:
                left = [t for t, d in docs.items() if d >= often]
                self.groups[lang, source] = Counter({t: n[t] for t in left}), Counter({t: docs[t] for t in left})
                self.held += len(left)
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])


def _term_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, term, lang_n, row) of the kept terms of (lang, source, text): all occurrences, and the number in each source that has any.

    Counts go to the place of their term once; there sources are merged and put beside each other.  A task keeps its
    frequent terms to the end, so that they come once from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Merged()
        for batch in batches:
            for k in range(0, len(batch), 256):
                for lang, source, text in zip(*(c.slice(k, 256).to_pylist() for c in batch.columns)):
                    merged.add((lang, source), text)
                    if merged.held >= settings.flush:
                        yield merged.sent(settings.often)
                        if 2 * merged.held >= settings.flush:
                            yield merged.sent()
        yield merged.sent()

    held = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, _COUNTED).repartition("lang", "term")
    held = held.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("lang", "term")
    held = held.agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("row"))
    return materialize(held.filter(F.col("docs") >= settings.min_docs).drop("docs"), "kept-terms")


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), null without terms."""
    return F.expr(f"cast(1 + (1000000000 * cast({count} + 1 as decimal(19, 0))) div nullif({total} + {kept}, 0) as long)")


def _apart(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q); shares stay below 2^30, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


_PAIR = "lang string, source string, item string, value decimal(38, 0)"


def tree_sums(offsets: np.ndarray, sources: np.ndarray, shares: np.ndarray, bases: np.ndarray, times: np.ndarray, combinations: int):
    """Corrections of the rows of one language, which are sorted: codes of source and item, and the value of each pair.

    Row r holds the entries offsets[r] to offsets[r + 1], in the order of sources: each a source's code, the share of the row's
    terms there, and the share of a term that the source lacks; ``times`` is the number of terms with that row.
    """
    sizes = np.diff(offsets)
    n, owner = len(sources), np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(n) - offsets[owner]
    # An entry begins a new node unless it and all before it are those of the row above.
    above = np.where((owner > 0) & (depth < sizes[np.maximum(owner - 1, 0)]), offsets[np.maximum(owner - 1, 0)] + depth, -1)
    equal = (above >= 0) & (sources[above] == sources) & (shares[above] == shares)
    differs = np.concatenate([[0], np.cumsum(~equal)])
    shared = equal & (differs[np.arange(n) + 1] == differs[offsets[owner]])
    nodes = np.flatnonzero(~shared)
    # A node's terms: its row's and those of the rows below that go on sharing it.
    by_depth = np.lexsort((np.arange(n), depth))
    starts = np.flatnonzero(~shared[by_depth])
    passing = np.empty(n, np.int64)
    if n:
        passing[by_depth[starts]] = np.add.reduceat(times[owner[by_depth]], starts)
    codes, values = [], []
    width = int(sources.max()) + 1 if n else 1
    ends = np.cumsum(depth[nodes])
    at = 0
    while at < len(nodes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + combinations, "right")))
        part = nodes[at:stop]
        at = stop
        d = depth[part]
        low = np.repeat(part, d)
        high = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(offsets[owner[part]], d)
        m = passing[low]
        for a, b in ((low, high), (high, low)):
            p, q, p0, q0 = shares[a], shares[b], bases[a], bases[b]
            # ``both`` as it is, less what the parts for one source and for none have counted.
            both = (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0
            code = sources[a] * width + sources[b]
            found, back = np.unique(code, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, back, m * both)
            codes.append(found)
            values.append(total)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, back = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, np.concatenate(values))
    return found // width, found % width, total


def _corrections(rows: DataFrame, settings: Settings) -> DataFrame:
    """What a tree of the rows (lang, row, times), in their order, adds to each pair of sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            cuts = [k for k in range(len(langs)) if k == 0 or langs[k] != langs[k - 1]] + [len(langs)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                lists = batch.column(1).slice(a, b - a)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.flatten()
                names = flat.field(0).dictionary_encode()
                left, right, value = tree_sums(
                    offsets - offsets[0], names.indices.to_numpy().astype(np.int64), flat.field(1).to_numpy(), flat.field(2).to_numpy(),
                    batch.column(2).slice(a, b - a).to_numpy(), settings.combinations,
                )
                columns = [pa.array([langs[a]] * len(left), pa.string()), names.dictionary.take(pa.array(left)), names.dictionary.take(pa.array(right))]
                columns.append(pa.array(value, pa.int64()).cast(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    return rows.select("lang", "row", "times").mapInArrow(run, _PAIR)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", settings: Settings = Settings()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, part ``term`` the terms
    that the source has more of than its language, the ``top_terms`` furthest ones."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    held = _term_rows(docs, settings)
    kept = held.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = held.select("lang", "term", "lang_n", F.explode("row").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"]).withColumn("p0", _share("0", "total", "kept"))
    groups = materialize(groups, "groups")

    entries = held.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept"))
    entries = materialize(entries.select("lang", "source", "term", "p", "p0", _share("lang_n", "lang_total", "kept").alias("q")), "shares")

    # Part 1, and part 2 by the distinct shares of each source.
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    paired = (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item"))
    none = groups.join(other, paired).select("lang", "source", "item", (F.coalesce(_apart("p0", "q0"), F.lit(0)).cast("decimal(38, 0)") * F.col("kept")).cast("decimal(38, 0)").alias("value"))
    alone = materialize(entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")), "distinct-shares")
    one = alone.join(other, paired)
    times = lambda v: (v.cast("decimal(20, 0)") * F.col("terms").cast("decimal(18, 0)")).cast("decimal(38, 0)")
    left = one.select("lang", "source", "item", times(_apart("p", "q0") - _apart("p0", "q0")).alias("value"))
    right = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), times(_apart("q0", "p") - _apart("q0", "p0")).alias("value"))

    # Part 3.
    rows = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("row"))
    rows = materialize(rows.filter(F.size("row") > 1).groupBy("lang", "row").agg(F.count("*").alias("times")), "term-rows")
    # By hashes of beginnings, as the driver sees a sample of what ranges are made of; the last parts rows that begin alike.
    begins = [F.xxhash64(F.slice("row", 1, n)) for n in (1, 2, 4)]
    both = _corrections(rows.repartitionByRange("lang", *begins, F.xxhash64("row")).sortWithinPartitions("lang", "row"), settings)

    pairs = none.unionByName(left).unionByName(right).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    placed = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", placed).filter(F.col("rank") <= settings.top_terms)
    return pairs.withColumn("rank", placed).unionByName(terms)
