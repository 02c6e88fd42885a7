"""Toxicity by a learned lexicon, matched with misspellings and weighed by context.

Learning: from a bounded sample of labelled documents, terms are taken that stand in many different
contexts of toxic documents and in next to no clean one.  Contexts are counted, not documents, so
that copies of one document do not make terms of its rare words.

Matching: the terms form a trie.  A word is met by walking the trie together with the Levenshtein
automaton of the word (its states are rows of edit distances, dropped as soon as no entry is within
reach), so terms with one wrong, missing or extra letter are found.  Words that clean documents of the
sample contain are never taken for misspellings.

Scoring: every hit has the share of toxic contexts of its term, less for a misspelling, less again if
the window around it marks a quotation.  The score of a document is s / (s + 0.5) for the sum s.

The model is a small table of terms, bounded by the sample; documents are scored where they lie, in
one pass without a shuffle.

Defined results: null and empty texts score 0; null ids are scored, never held out, never learnt from;
repeated rows are scored alike; without labels nothing is toxic; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.scratch import materialize

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_QUOTES = "\"'“”„«»‘’‹›"
# Words that introduce someone else's words.
_REPORTING = frozenset("said says wrote writes quote quoted quoting reported sagte schrieb dit écrit dijo escribió".split())
_CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """Parameters. ``train_rows`` bounds the labelled sample that the lexicon is learnt from."""

    train_rows: int = 10_000
    min_contexts: int = 6
    min_odds: float = 30.0
    min_fuzzy_letters: int = 5
    misspelt_weight: float = 0.7
    quoted_weight: float = 0.25
    window: int = 8


def _deletions(word: str) -> set[str]:
    """The word and every string that one deleted letter leaves of it."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _edits(a: str, b: str) -> int:
    """Levenshtein distance if it is 0 or 1, else 2."""
    if a == b:
        return 0
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if len(long) - len(short) != 1:
        return 2
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return 1 if short[i:] == long[i + 1 :] else 2


@dataclass
class Lexicon:
    """Terms with their weights, words known to be clean, and the fuzzy terms by themselves and their one-letter deletions."""

    weights: dict[str, float]
    clean: frozenset[str] = frozenset()
    settings: Settings = Settings()
    variants: dict = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.variants = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term in self.weights:
            if len(term) >= self.settings.min_fuzzy_letters:
                for key in _deletions(term):
                    self.variants.setdefault(key, []).append(term)
                half = min(3, len(term) // 2)
                self.heads.add(term[:half])
                self.tails.add(term[-half:])

    def near(self, word: str) -> str | None:
        """The best term within one edit of ``word``: least distance, then greatest weight, then first."""
        n = len(word)
        # One edit leaves the first or the last letters of the term alone.
        if n + 1 < self.settings.min_fuzzy_letters or not (
            word[:2] in self.heads or word[:3] in self.heads or word[-2:] in self.tails or word[-3:] in self.tails
        ):
            return None
        # Within one edit, the word and the term are equal, or equal after one deletion from one of them or from both.
        found: list[tuple[int, float, str]] = []
        for key in _deletions(word):
            for term in self.variants.get(key, ()):
                d = _edits(word, term)
                if d <= 1:
                    found.append((d, -self.weights[term], term))
        return min(found)[2] if found else None


class _Matcher(dict):
    """Raw lower-case word -> 0, or (term, weight); filled on demand and emptied when it is large."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        if len(self) > _CACHE_WORDS:
            self.clear()
        word, lex, hit = _EDGE.sub("", raw), self.lexicon, 0
        if word in lex.weights:
            hit = (word, lex.weights[word])
        elif word and word not in lex.clean and (term := lex.near(word)) is not None:
            hit = (term, lex.weights[term] * lex.settings.misspelt_weight)
        self[raw] = hit
        return hit


def quoted(words: list[str], i: int, window: int) -> bool:
    """Whether the word lies inside quotation marks, or shortly behind a reporting word and an opening mark."""
    before, after = words[max(0, i - window) : i + 1], words[i : i + window + 1]
    opened = any(w[0] in _QUOTES and not (len(w) > 1 and w[-1] in _QUOTES and k < len(before) - 1) for k, w in enumerate(before) if w)
    closed = any(w.rstrip(".,;:!?")[-1:] in tuple(_QUOTES) for w in after if w)
    if opened and closed:
        return True
    return any(_EDGE.sub("", w) in _REPORTING for w in before[-4:-1]) and (opened or closed)


def score_text(text: str | None, matcher: _Matcher) -> tuple[float, int, int, list[str]]:
    """Score, hits, quoted hits and the terms of one text."""
    words = (text or "").lower().split()
    codes = [matcher[w] for w in words]
    total, hits, quotes, terms = 0.0, 0, 0, []
    if any(codes):
        settings = matcher.lexicon.settings
        for i, code in enumerate(codes):
            if code:
                q = quoted(words, i, settings.window)
                total += code[1] * (settings.quoted_weight if q else 1.0)
                hits, quotes = hits + 1, quotes + q
                terms.append(code[0])
    return total / (total + 0.5), hits, quotes, sorted(set(terms))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Texts of at most ``train_rows`` labelled documents outside the held-out fold, written once."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Bounded by train_rows (16 bytes each): a broadcast keeps the texts where they are.
    return materialize(texts.join(F.broadcast(known), "doc_id").select("toxic", "text"), "toxic-sample")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def _contexts(keep: frozenset[str] | None):
    """Rows (word, context) of the texts: a hash of the neighbours for every word, or for those in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows: set[tuple[str, str]] = set()
            for text in batch.column(0).to_pylist():
                words = [""] + [_EDGE.sub("", w) for w in (text or "").lower().split()] + [""]
                for i in range(1, len(words) - 1):
                    if words[i] and (keep is None or words[i] in keep):
                        rows.add((words[i], f"{words[i - 1]} {words[i + 1]}"))
            yield pa.RecordBatch.from_pydict(
                {"word": [r[0] for r in rows], "context": [r[1] for r in rows]}, schema=pa.schema([("word", pa.string()), ("context", pa.string())])
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Lexicon:
    """Lexicon from the labelled sample. What comes to the driver is bounded by the sample."""
    taught = sample(docs, labels, settings)
    by_class = {int(r["toxic"]): r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in by_class.items() if k > 0), by_class.get(0, 0)
    toxic, clean = (taught.filter(c).select("text") for c in (F.col("toxic") > 0, F.col("toxic") <= 0))
    schema = "word string, context string"
    counted = lambda texts, keep: (
        texts.mapInArrow(_contexts(keep), schema).distinct().groupBy("word").agg(F.count("*").alias("n"))
    )
    many = {r["word"]: r["n"] for r in counted(toxic, None).filter(F.col("n") >= settings.min_contexts).collect()}
    seen = {r["word"]: r["n"] for r in counted(clean, frozenset(many)).collect()}
    rate = (n_clean + 1) / (n_toxic + 1)
    weights = {}
    for word, n in many.items():
        odds = (n + 0.5) / (seen.get(word, 0) + 0.5) * rate
        if odds >= settings.min_odds:
            weights[word] = odds / (odds + 1)
    draft = Lexicon(weights, frozenset(), settings)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = {_EDGE.sub("", w) for t in batch.column(0).to_pylist() for w in (t or "").lower().split()}
            found = [w for w in words if w and w not in draft.weights and draft.near(w) is not None]
            yield pa.RecordBatch.from_pydict({"word": found}, schema=pa.schema([("word", pa.string())]))

    exempt = frozenset(r["word"] for r in clean.mapInArrow(close, "word string").distinct().collect())
    return Lexicon(weights, exempt, settings)


_SCORED = "doc_id {id}, score double, n_hits long, n_quoted long, terms array<string>"


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, score, n_hits, n_quoted, terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(lexicon)
        for batch in _slices(batches):
            scored = [score_text(t, matcher) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s[0] for s in scored], pa.float64()),
                    pa.array([s[1] for s in scored], pa.int64()),
                    pa.array([s[2] for s in scored], pa.int64()),
                    pa.array([s[3] for s in scored], pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "n_hits", "n_quoted", "terms"],
            )

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _SCORED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the hits behind the score."""
    scored = score(docs, learn(docs, labels, settings))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
        "n_quoted",
        "terms",
    )


def clean_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are not toxic, with all their columns. The score is a filter on the rows as they lie."""
    lexicon = learn(docs, labels, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(lexicon)
        for batch in _slices(batches):
            keep = [score_text(t, matcher)[0] < 0.5 for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
