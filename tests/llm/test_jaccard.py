"""Near duplicates against all pairs, and components against a plain search."""

import random
from collections import Counter

from parcelflow.llm import jaccard
from parcelflow.llm.components import components

from .corpus import documents, frame

FIRST = 1 << 62


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, FIRST), FIRST if name is None else name)
    named = [least[find(i)] for i in range(len(rows))]
    return Counter((rows[i][0], len(sets[i]), None if named[i] == FIRST else named[i]) for i in range(len(rows))), len(set(map(find, range(len(rows)))))


def test_near_duplicates(spark):
    rows = documents()
    rng = random.Random(3)
    base = documents()[311 - 311 + 6][1].split(" ") + ["tail"] * 3
    for k in range(60):  # a chain of texts that drift apart
        base = [w for w in base]
        base[rng.randrange(len(base))] = f"drift{k}"
        rows.append((1000 + k, " ".join(base)))
    want, n = brute(rows)
    for block_bytes, group_shingles in ((4_000, 300), (1 << 20, 200_000)):
        settings = jaccard.Settings(block_bytes=block_bytes, group_shingles=group_shingles)
        got = jaccard.near_duplicates(frame(spark, rows), settings=settings).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert sum(r["first"] for r in got) == n


def test_texts_alike_that_are_not_all_linked(spark):
    rng = random.Random(8)
    base = [f"word{k}" for k in range(120)]
    rows = []
    for k in range(500):
        own = list(base)
        for _ in range(2 + k % 4):  # every change takes five shingles, so similarities lie on both sides of 0.75
            own[rng.randrange(len(own))] = f"new{k}x{rng.randrange(9)}"
        rows.append((k, " ".join(own)))
    want, n = brute(rows)
    assert 20 < n < 480
    for group_shingles in (2_000, 200_000):
        settings = jaccard.Settings(block_bytes=20_000, group_shingles=group_shingles)
        got = jaccard.near_duplicates(frame(spark, rows), settings=settings).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_links_of_connects_what_is_linked():
    rng = random.Random(4)
    settings = jaccard.Settings()
    for split in (0, 0, 9, 21):
        sets = []
        for k in range(30):
            kept = [t for t in range(40) if rng.random() < 0.9]
            sets.append(sorted(kept + [1000 + 50 * k + j for j in range(rng.randrange(6))]))
        sets[3] = list(sets[2])
        pairs = [(i, j) for i in range(30) for j in range(i) if not split or j < split <= i]
        linked = [(i, j) for i, j in pairs if settings.linked(len(set(sets[i]) & set(sets[j])), len(sets[i]), len(sets[j]))]

        def classes(edges):
            root = list(range(30))
            for a, b in edges:
                root = [root[a] if r == root[b] else r for r in root]
            return {frozenset(i for i in range(30) if root[i] == r) for r in root}

        got = jaccard.links_of(range(30), [jaccard.np.array(t) for t in sets], split, settings)
        assert set(got) <= set(linked) | {(j, i) for i, j in linked}
        assert len(got) < 30 and classes(got) == classes(linked) and 0 < len(linked)


def test_first_of_each_keeps_columns(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (4, None), (None, "q r s t u v")]
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = jaccard.first_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.select("doc_id", "text").collect() if r["text"])
    assert [k[2] for k in kept] == ["a b c d e f g", "q r s t u v"]
    assert got.count() == 4


def test_first_of_each_when_files_are_packed_anew(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(20 + 10 * (k % 7))) for k in range(40)]
    for k in range(8):  # files of different sizes, each with copies of texts of other files
        own = [(100 * k + j, t) for j, t in enumerate(texts[5 * k : 5 * k + 5] + texts[: 3 * k])]
        spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2k")
        got = jaccard.first_of_each(spark.read.parquet(str(tmp_path / "docs")))
        spark.conf.set(key, "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        kept = [r["text"] for r in got.collect()]
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(kept) == sorted(texts)


def test_empty(spark):
    assert jaccard.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(7, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in want:
                want[n] = start
                stack.extend(near[n])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
