"""Divergence of sources against sums over all terms in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = TERM.findall((text or "").translate(LOWER))
        counts[group].update(terms)
        seen[group[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(120)] + ["Ünder", "x_y", "DON'T", "日本", "a1b2", "\x7fdel\x00nul"]
    out = []
    for k in range(400):
        lang = rng.choice(["en", "en", "de", "fr", None])
        source = rng.choice(["s0"] * 6 + [f"s{k}" for k in range(9)] + [None])
        text = " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 60)))
        out.append((text, lang, source))
    out += [out[3]] * 7  # repeated rows
    out += [("", "en", "empty"), (None, "en", "none"), ("...", "pt", "s1"), (None, "pt", "s2"), ("only once", "it", "s1"), (None, None, None), ("same " * 30_000, "en", "s3")]
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for name in "term n docs row e p p0 q l item kept total rank value times doc_id".split():
        df = df.selectExpr("*", f"'x' as {name}")
    return df.repartition(5)


@pytest.mark.parametrize("changes", [{}, {"flush": 5, "combinations": 3, "top_terms": 4}, {"flush": 30, "often": 2}, {"min_docs": 1}])
def test_audit(spark, changes):
    limits = divergence.Settings(**changes)
    got = divergence.audit(frame(spark, rows()), settings=limits)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows(), limits.min_docs, limits.top_terms)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_empty(spark):
    assert divergence.audit(frame(spark, rows()).limit(0)).count() == 0


ENTRY = st.tuples(st.integers(0, 4), st.integers(1, 4))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(ENTRY, min_size=2, max_size=5, unique_by=lambda e: e[0]), st.integers(1, 9)), max_size=12), st.integers(1, 30))
def test_tree(rows, combinations):
    """Shared paths add up to the same sums as all pairs of each row."""
    rows = sorted((sorted(r), m) for r, m in rows)
    base = [3, 5, 2, 7, 4]
    want = Counter()
    for row, m in rows:
        for a, p in row:
            for b, q in row:
                if a != b:
                    p0, q0 = base[a], base[b]
                    f = lambda x, y: (x - y) ** 2 // y
                    want[a, b] += m * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    flat = [e for r, _ in rows for e in r]
    array = lambda x: np.array(x, np.int64)
    offsets = np.concatenate([[0], np.cumsum(array([len(r) for r, _ in rows]))]).astype(np.int64)
    got = divergence.tree_sums(
        offsets, array([a for a, _ in flat]), array([p for _, p in flat]), array([base[a] for a, _ in flat]), array([m for _, m in rows]), combinations
    )
    assert {(int(a), int(b)): int(v) for a, b, v in zip(*got)} == dict(want)
