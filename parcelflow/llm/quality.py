"""Quality rules on whole texts: simple counts, and the divergence of a text from its language.

A text is described by two histograms: characters by class, and common words of its language.
The language reference is the sum of those histograms over all documents of the same language,
and a text is rejected when the Jensen-Shannon distance to its reference is too large.  Texts
that are too short for a stable histogram are not judged by it.

Everything is built-in Column work; nothing leaves the JVM.  Counting needs no shuffle, the
references are one small aggregate (a row per language), so no key can become hot.

Defined results: a null text counts as the empty text (no words, base_failed); an empty table gives
an empty result; repeated rows and equal ids are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.scratch import materialize

_SPACE = r"\x20\x09-\x0D"
_EDGES = ".,;:?\"'()"

# The most common function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he or are this at from an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}

# Character classes: a name and the regular expression of a run of it; what is left is "other".
CHAR_CLASSES = {
    "lower": "[a-z]+",
    "upper": r"[A-Z\p{Lu}]+",
    "digit": "[0-9]+",
    "space": f"[{_SPACE}]+",
    "stop": "[.,;:?'()-]+",
    "mark": r"[\x21-\x7E&&[^A-Za-z0-9.,;:?'()-]]+",
}


ANY = "*"  # the language of a text without any common word; its reference is the sum of all


@dataclass(frozen=True)
class Rules:
    """Limits. Distances are square roots of the Jensen-Shannon divergence in bits, 0 to 1."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    min_chars_judged: int = 200
    min_words_judged: int = 30
    reference_percent: int = 15  # common words that a text must have to count for the reference
    max_char_distance: float = 0.2
    max_word_distance: float = 0.35
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")


def _runs(text: Column, pattern: str) -> Column:
    """Characters in runs of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text. Positions are only sorted for texts
    that have a repeated window at all.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(p: Column) -> Column:
            pairs = F.zip_with(
                F.slice(p, 1, F.size(p) - 1),
                F.slice(p, 2, F.size(p) - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

            def length(s: Column) -> Column:
                steps = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
                return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

            return _let(starts, length)

        return _let(placed, of)

    some = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(hashes, covered)).otherwise(F.lit(0).cast("long"))
    return F.when(n > width, some).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(words: list[str]) -> Column:
    return F.size(F.filter("common_hits", lambda w: w.isin(*words))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and histograms of every text: doc_id, n_words, the four base counts, n_chars, chars, lang_guess, hits, common."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _runs(F.col("text"), "[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.repeat_window).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*[_runs(F.col("text"), p).cast("long") for p in CHAR_CLASSES.values()]).alias("runs"),
        F.filter(F.transform("words", lambda w: F.btrim(F.lower(w), F.lit(_EDGES))), lambda w: w.isin(sorted({w for ws in rules.common_words.values() for w in ws}))).alias("common_hits"),
    )
    per_language = [
        F.struct(
            _hits(ws).alias("hits"),
            F.lit(-k).alias("rank"),
            F.lit(name).alias("name"),
        )
        for k, (name, ws) in enumerate(rules.common_words.items())
    ]
    t = t.withColumn("best", F.array_max(F.array(*per_language)))
    longest = max(len(ws) for ws in rules.common_words.values())
    counts = F.lit(None).cast("array<bigint>")
    for name, ws in rules.common_words.items():
        hit = F.transform(
            F.array(*[F.lit(w) for w in ws]), lambda w: F.size(F.filter("common_hits", lambda x: x == w)).cast("long")
        )
        padded = F.concat(hit, F.array_repeat(F.lit(0).cast("long"), longest - len(ws)))
        counts = F.when(F.col("best.name") == name, padded).otherwise(counts)
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_chars",
        F.concat("runs", F.array(F.col("n_chars") - total)).alias("chars"),
        F.when(F.col("best.hits") > 0, F.col("best.name")).otherwise(F.lit(ANY)).alias("lang_guess"),
        F.col("best.hits").alias("hits"),
        F.concat(counts, F.array(F.col("n_words") - F.col("best.hits"))).alias("common"),
    )


def references(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The summed histograms of all texts fit to be a reference: one row per language, and one of all."""
    fit = (
        (F.col("lang_guess") != ANY)
        & (F.col("n_words") >= rules.min_words_judged)
        & (100 * F.col("hits") >= rules.reference_percent * F.col("n_words"))
        & (100 * F.col("n_repeat_words") <= rules.max_repeat_percent * F.col("n_words"))
    )
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(f"ref_{c}")
    longest = max(len(ws) for ws in rules.common_words.values())
    totals = measured.filter(fit).rollup("lang_guess").agg(sums("chars", len(CHAR_CLASSES) + 1), sums("common", longest + 1))
    return totals.withColumn("lang_guess", F.coalesce("lang_guess", F.lit(ANY)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two count arrays; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        terms = F.zip_with(
            p,
            q,
            lambda a, b: F.element_at(
                F.transform(
                    F.array(F.struct((F.coalesce(a, F.lit(0)) / sums["p"]).alias("x"), (F.coalesce(b, F.lit(0)) / sums["q"]).alias("y"))),
                    lambda s: 0.5 * part(s["x"], (s["x"] + s["y"]) / 2) + 0.5 * part(s["y"], (s["x"] + s["y"]) / 2),
                ),
                1,
            ),
        )
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the two distances (null where not judged)."""
    measured = materialize(measures(docs, id_col, text_col, rules), "quality")
    # At most one row per configured language: bounded by the parameter, whatever the input.
    refs = F.broadcast(references(measured, rules))
    joined = measured.join(refs, "lang_guess", "left")
    judged = joined.select(
        "*",
        F.when(F.col("n_chars") >= rules.min_chars_judged, js_distance(F.col("chars"), F.col("ref_chars"))).alias("char_distance"),
        F.when(F.col("n_words") >= rules.min_words_judged, js_distance(F.col("common"), F.col("ref_common"))).alias("word_distance"),
        (
            (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
        ).alias("base_failed"),
    )
    off = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > rules.max_char_distance) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > rules.max_word_distance
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~off).alias("kept"),
        "lang_guess",
        "char_distance",
        "word_distance",
    )
