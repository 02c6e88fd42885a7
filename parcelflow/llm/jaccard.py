"""Near duplicates by set similarity: a Jaccard join over word shingles with a token-group matrix.

A document is the set of its shingles of ``shingle`` words, as 64-bit hashes; two documents link when their sets have a similarity of
``percent`` or more.  All links are found; what is avoided is looking where none can be.

1. A document with a link shares part of its prefix (the shingles with the least hashes, half of them) with another one's.  Documents whose
   prefix does not recur often enough in all documents (``blocks.recurring``) have no link and leave.
2. Documents with equal sets are one.
3. Similar documents are partitioned into groups: those whose recurring shingles have the same least hash, dealt by hash to
   several groups where they hold more than ``group_shingles``.
4. The token-group matrix holds the rare shingles of every group, the union of its members', with their sizes.  Groups
   of different least hashes meet where they share one, which a link must; groups of one least hash always meet.
5. Where two groups meet, the union of all shingles of one bounds the overlap of every document of the other with its members;
   the group is opened for those where that suffices, and for none that is connected with all of it already.
6. Links give components, in alternating stars.

Prefixes for step 4 take the rarest shingles first, so a passage in a third of all documents brings no candidates.
Copies are one document; documents alike, linked or not, meet as groups, so joins hold pairs of groups and not of documents.

Defined results: a null text, or one without words, is an empty set and links with nothing, not even another such; with fewer than
``shingle`` words the words are one shingle; a null id is never the smallest unless there is no other; repeated rows are
documents like any other, equal sets always link; a similarity of exactly ``percent`` links; texts of any length are read whole,
and one with more than ``group_shingles`` shingles makes its group larger; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.scratch import materialize

from . import blocks as B
from .components import components
from .phrases import Words


@dataclass(frozen=True)
class Settings:
    """``percent`` is at least 50; ``group_shingles`` bounds what a task compares at once, results do not depend on it."""

    shingle: int = 5
    percent: int = 75
    group_shingles: int = 200_000
    block_bytes: int = B.BLOCK_BYTES

    def overlap(self, n):
        """Least overlap of a set of ``n`` with any set it links to."""
        return -(-n * self.percent // 100)

    def linked(self, common, n, m):
        """common / (n + m - common) >= percent / 100."""
        return common * (100 + self.percent) >= self.percent * (n + m)


def shingle_sets(block: B.Block, settings: Settings) -> list[np.ndarray]:
    """The sorted distinct shingles of every document of a block."""
    words = Words(block, settings.shingle, lower=True)
    grams = words.rolled(settings.shingle, 0x9E3779B97F4A7C15)
    out = []
    for a, own in zip(words.starts.tolist(), words.lists):
        n = len(own)
        if n >= settings.shingle:
            out.append(np.unique(grams[a : a + n - settings.shingle + 1]))
        elif n:
            short = hashlib.blake2b(b" ".join(own), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(short, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _margin(n: int) -> int:
    return 1 + n // 4


def hash_prefix(tokens: np.ndarray, settings: Settings) -> np.ndarray:
    """The least hashes; linked sets share at least the smaller ``_margin`` of both among theirs."""
    n = len(tokens)
    return tokens[: n - settings.overlap(n) + _margin(n)]


_SETS = "uid long, doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>"


def _sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """One row per document; tokens only where a link is possible."""
    buckets = B.buckets_for(texts, 0.06)

    def send(block: B.Block) -> pd.DataFrame:
        prefixes = [hash_prefix(t, settings) for t in shingle_sets(block, settings)]
        return B.sent(block.number, *B.distinct_keys(np.concatenate(prefixes)), buckets)

    back = B.recurring(B.each_block(texts, send, B.SENT))

    def choose(block: B.Block, rows: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(block, settings)
        prefixes = [hash_prefix(t, settings) for t in sets]
        recurs = B.known(np.concatenate(prefixes), rows, buckets)
        ends = np.cumsum([len(p) for p in prefixes])
        counts = np.diff(np.concatenate([[0], np.cumsum(recurs)])[np.concatenate([[0], ends])])
        digests = [np.frombuffer(hashlib.blake2b(t.tobytes(), digest_size=16).digest(), np.int64) for t in sets]
        possible = [len(t) > 0 and c >= _margin(settings.overlap(len(t))) for t, c in zip(sets, counts.tolist())]
        return pd.DataFrame(
            {
                "uid": (block.number << 16) + np.arange(len(sets)),
                "doc_id": block.ids,
                "n_shingles": [len(t) for t in sets],
                "d1": [int(d[0]) for d in digests],
                "d2": [int(d[1]) for d in digests],
                "tokens": [t.view(np.int64) if p else None for t, p in zip(sets, possible)],
            }
        )

    return materialize(B.by_block(texts, back, choose, _SETS), "sets")


def _recurring_tokens(sets: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """For every block, the keys of its shingles that recur, and how often sets hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy() >> 16
            lists = batch.column(1)
            flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for number in np.unique(numbers).tolist():
                mine = np.flatnonzero(numbers == number)
                held = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in mine.tolist()])
                keys, counts = np.unique(held, return_counts=True)
                rows = B.sent(number, keys, np.minimum(counts, 255).astype(np.uint8), buckets)
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    sent = sets.select("uid", "tokens").mapInArrow(run, B.SENT)
    return B.counted(sent)


def least_hash(tokens: np.ndarray) -> int:
    """The shingle that comes first in a mixed order, as a signed number."""
    with np.errstate(over="ignore"):
        mixed = tokens * np.uint64(0xD6E8FEB86659FD93)
    return int((mixed ^ (mixed >> np.uint64(32))).min()) - (1 << 63)


_MEMBER = "uid long, n long, least long, prefix array<long>, tokens array<long>"


def _members(sets: DataFrame, firsts: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """The distinct sets with the least hash of their recurring shingles and their prefix of rare shingles.

    A set of which fewer shingles recur than any link needs leaves.
    """
    back = _recurring_tokens(sets, buckets, settings).select("block", "bucket", "keys", "sizes", F.lit(None).cast("long").alias("uid"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("bucket", "long"), ("keys", "binary"), ("sizes", "binary"))]
    own = firsts.select(F.shiftright("uid", 16).alias("block"), *nothing, "uid")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        first = set(right["uid"].dropna().astype("int64"))
        left = left[left["uid"].isin(first)].sort_values("uid")
        back_rows = right[right["keys"].notna()].astype({"bucket": "int64"})
        rows = []
        sizes = [len(t) for t in left["tokens"]]
        if sizes:
            flat = np.concatenate([np.asarray(t) for t in left["tokens"]]).view(np.uint64)
            often = B.sizes_of(flat, back_rows, buckets)
            for uid, n, e in zip(left["uid"].tolist(), sizes, np.cumsum(sizes).tolist()):
                tokens, size = flat[e - n : e], often[e - n : e]
                if (size >= 0).sum() < settings.overlap(n):
                    continue
                # Rarest first, in steps of doubling; the tokens are in order of their hashes.
                prefix = tokens[np.argsort(size, kind="stable")][: n - settings.overlap(n) + 1]
                # Shingles of one text alone would part it from texts alike.
                rows.append((uid, n, least_hash(tokens[size >= 0]), prefix.view(np.int64), tokens.view(np.int64)))
        return pd.DataFrame(rows, columns=["uid", "n", "least", "prefix", "tokens"])

    held = sets.select(F.shiftright("uid", 16).alias("block"), "uid", "tokens")
    made = held.groupBy("block").cogroup(back.unionByName(own).groupBy("block")).applyInPandas(run, _MEMBER)
    return materialize(made, "members")


def _groups(members: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The groups: (uid, n, least, g, prefix) of the members, and the pairs (g, og) of groups of one least hash."""
    one = members.groupBy("least").agg(F.sum("n").alias("size"), F.count("*").alias("members"))
    one = one.filter("members > 1").withColumn("parts", F.ceil(F.col("size") / settings.group_shingles).cast("long"))
    one = materialize(one.select(F.col("least").alias("of"), "parts"), "families")
    name = lambda least, part: F.xxhash64(least, part)
    part = F.coalesce(F.pmod(F.xxhash64("uid"), "parts"), F.lit(0).cast("long"))
    placed = members.select("uid", "n", "least", "prefix").join(one, F.col("least") == F.col("of"), "left")
    placed = materialize(placed.select("uid", "n", "least", name(F.col("least"), part).alias("g"), "prefix"), "grouped")
    low = one.select("of", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("a"))
    both = low.select("of", "a", F.explode(F.sequence("a", F.col("parts") - 1)).alias("b"))
    return placed, both.select(name(F.col("of"), F.col("a")).alias("g"), name(F.col("of"), F.col("b")).alias("og"))


def _met(placed: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (g, og) of groups of different least hashes that share a rare shingle of sets of fitting sizes."""
    rare = placed.select("g", "least", "n", F.explode("prefix").alias("token"))
    # The matrix, a row per group and rare shingle, with the sizes of the sets behind.
    matrix = rare.groupBy("token", "g", "least").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    shared = matrix.groupBy(F.col("token").alias("t")).agg(F.count_distinct("least").alias("groups")).filter("groups > 1")
    matrix = materialize(matrix.join(shared.select("t"), F.col("token") == F.col("t")).drop("t"), "matrix")
    other = matrix.select("token", *[F.col(c).alias(f"o{c}") for c in ("g", "least", "low", "high")])
    fits = (F.col("high") * 100 >= F.col("olow") * settings.percent) & (F.col("ohigh") * 100 >= F.col("low") * settings.percent)
    met = matrix.join(other, "token").filter((F.col("least") != F.col("oleast")) & (F.col("g") < F.col("og")) & fits)
    return met.select("g", "og").distinct()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])


def links_of(uids: np.ndarray, sets: list[np.ndarray], first: int, settings: Settings) -> list[tuple[int, int]]:
    """Links that connect what is linked: of the sets from ``first`` on with those before, or of all if ``first`` is 0.

    The union of the group asked bounds the overlap of every set with any of its members; only sets for which it
    suffices are compared, and those that are connected with all of the group already are not.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    asked, asking = (sets[:first], sets[first:]) if first else (sets, sets)
    if not asked or not asking:
        return []
    flat, owner = _flat(asked)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(t) for t in asked])
    words, of = _flat(asking)
    low = np.searchsorted(flat, words, "left")
    many = np.searchsorted(flat, words, "right") - low
    held = np.bincount(of[many > (0 if first else 1)], minlength=len(asking))  # within a group a set holds its own
    ends = np.concatenate([[0], np.cumsum([len(t) for t in asking])])
    found = []
    for k in np.flatnonzero(held >= [settings.overlap(len(t)) for t in asking]).tolist():
        mine = find(first + k)
        if all(find(i) == mine for i in range(len(asked))):
            continue
        a, m = low[ends[k] : ends[k + 1]], many[ends[k] : ends[k + 1]]
        at = np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())
        common = np.bincount(owner[at], minlength=len(asked))
        for i in np.flatnonzero(settings.linked(common, ends[k + 1] - ends[k], sizes)).tolist():
            if find(i) != find(first + k):
                root[find(i)] = find(first + k)
                found.append((int(uids[first + k]), int(uids[i])))
    return found


def _linked(pairs: DataFrame, placed: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between members of the pairs (g, og) of groups, enough to connect all that are linked."""
    ends = pairs.select("g", "og", F.explode(F.when(F.col("g") == F.col("og"), F.array("g")).otherwise(F.array("g", "og"))).alias("end"))
    named = placed.select("uid", F.col("g").alias("end"))
    sent = materialize(named.join(ends, "end").select("uid", "g", "og", (F.col("end") != F.col("g")).alias("right")), "opened")
    held = sent.join(members.select("uid", "tokens"), "uid")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["right", "uid"])
        sets = [np.asarray(t, np.int64) for t in rows["tokens"]]
        first = int((~rows["right"]).sum()) if rows["right"].any() else 0
        return pd.DataFrame(links_of(rows["uid"].to_numpy(), sets, first, settings), columns=["a", "b"]).astype("int64")

    return held.groupBy("g", "og").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), and uid, first.

    ``uid`` is the document's place; ``first`` marks one document of each component.
    """
    texts = B.pack(docs, id_col, text_col, settings.block_bytes)
    all_sets = _sets(texts, settings)
    possible = all_sets.filter("tokens is not null")
    firsts = possible.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "uid")).alias("m"))
    firsts = materialize(firsts.select("d1", "d2", F.col("m.doc_id").alias("doc_id"), F.col("m.uid").alias("uid")), "firsts")
    members = _members(possible, firsts, settings, B.buckets_for(texts, 0.16))
    placed, own = _groups(members, settings)
    pairs = own.unionByName(_met(placed, settings)).distinct()
    tied = materialize(components(_linked(pairs, placed, members, settings)), "tied")
    rooted = placed.select("uid").join(tied, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("root", "uid").alias("root"))
    placed = firsts.join(rooted, "uid")
    least = placed.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("doc_id", "uid")).alias("m"))
    named = placed.join(materialize(least, "least"), F.col("root") == F.col("r"))
    # Written, so that the join sees two shuffled sides and can split the copies of a hot document.
    named = materialize(named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "m"), "named")
    out = all_sets.select("uid", "doc_id", "n_shingles", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    known = lambda c: F.when(c != B.NO_ID, c)
    return out.select(
        known(F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        known(F.coalesce(F.col("m.doc_id"), F.col("doc_id"))).alias("component_id"),
        "uid",
        (F.coalesce(F.col("m.uid"), F.col("uid")) == F.col("uid")).alias("first"),
    )


def first_of_each(docs: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, without those that link to one that stays: the first of each component stays.

    The rows are written with their number once: a second scan may pack its files otherwise and number other rows.
    """
    rows = materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(_ROW, text_col), _ROW, text_col, settings)
    stay = found.filter("first").select(F.col("doc_id").alias(_ROW))
    return rows.join(stay, _ROW, "left_semi").drop(_ROW)


_ROW = "__row of the near-duplicate join"
