"""Periodic runs against a plain search of all lags."""

import hashlib
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import periodic

from .corpus import documents, frame


def plain_runs(w):
    """The smallest period of every maximal stretch, by comparing all words at all lags."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_rows(rows):
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((i, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


PIECES = st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 60))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=5), min_size=1, max_size=4), st.sampled_from([0, 1, 64]))
def test_runs(texts, patience):
    texts = [[(base * n)[k] for base, n in parts for k in range(n)] for parts in texts]
    found = periodic.runs_of(texts, periodic.Settings(patience=patience))
    assert [[tuple(r) for r in x.tolist()] for x in found] == [plain_runs(w) for w in texts]


def test_splitting_cuts_at_rare_words():
    import numpy as np

    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 0, 0, 0, 3, 1, 1, 1, 1, 1, 1])
    lo, hi = periodic.segments(words, np.array([0]), np.array([len(words)]), periodic.Settings())
    assert list(zip(lo.tolist(), hi.tolist())) == [(0, 8), (13, 19)]


@pytest.mark.parametrize("words", [[b"a"] * 300_000, [b"%d" % (i % 1000) for i in range(300_000)], [b"a", b"b"] * 50_000 + [b"a"] * 100_000])
def test_long_texts_stay_fast(words):
    began = time.time()
    found = periodic.runs_of([words])[0]
    assert time.time() - began < 20 and 1 <= len(found) <= 2


def hostile():
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    rows += [(400 + k, "x y " * k + "z " * k + "u v w " * 4 + "a\tb\x0bc\n" * (k % 7)) for k in range(1, 60)]
    return rows + [(500, "é e " * 30), (501, "one " * 5), (502, "one " * 6), (503, "a b a b a b a"), (504, "a b a b a b a b")]


@pytest.mark.parametrize("slice_bytes", [100, 1 << 20])
def test_query(spark, slice_bytes):
    rows = hostile()
    docs = frame(spark, rows)
    got = periodic.report(periodic.with_periodic_tails(docs), settings=periodic.Settings(slice_bytes=slice_bytes))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_rows(rows))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert got.columns == names and periodic.report(docs.limit(0)).columns == names


def test_operator(spark):
    rows = [(1, "one two one two one two one two three"), (None, None), (3, "")]
    got = {r["doc_id"]: r for r in periodic.find_runs(frame(spark, rows)).collect()}
    assert got[1]["kept"] == "one two three" and got[1]["n_words"] == 9
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 8, 2)]
    assert got[None]["runs"] == [] and got[3]["kept"] == "" and periodic.find_runs(frame(spark, rows).limit(0)).count() == 0
