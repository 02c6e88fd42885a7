"""The registered queries on the small tables, their SQL, and the pipeline against a plain version."""

import pytest

import __spark_entry__
import corpus_pipeline
from parcelflow.llm import decontam, jaccard, queries, toxicity

from ..compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) < set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n.startswith(("op1_", "op2_", "op9_"))])
def test_rows(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    rows = queries.QUERIES[name](spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count() or name.startswith("op9")


def test_pipeline(spark):
    """Stage by stage: who stays is what a plain version of the stage keeps."""
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    lexicon = toxicity.learn(docs, labels)
    matcher = toxicity._Matcher(lexicon)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    clean = [r for r in rows if toxicity.score_text(r[1], matcher)[0] < 0.5]
    sets = {}
    for i, t in sorted(clean):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {find(i) for i in ids}
    finder = next(decontam.finders(bench))
    texts = dict(clean)
    leaked = {i for i in ids if finder.search([texts[i]])}

    got = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    kept = {r["doc_id"] for r in got}
    assert len({find(i) for i in kept}) == len(kept) and kept <= set(ids) - leaked
    assert groups - {find(i) for i in kept} <= {find(i) for i in leaked}
    assert jaccard.Settings().percent == 75
