"""Sequences: every id once, no gaps, little padding, and the least cost of small cases."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parcelflow.llm import packing

from .corpus import documents, frame

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = ["it's 5.5 a.m... OK?! <|endoftext|> x.y,z", "ΑΣ ΣΑΣ İstanbul ǅ", "é é Å", "tab\there\x1cthere wide", "... .. , ,a b,", "don't 'll", "漢字 かな, ไทย."]


def test_words_give_the_ids_of_the_text():
    whole = tokenizers.Tokenizer.from_file(PATH)
    words = packing.WordTokens(PATH)
    texts = ODD + [t or "" for _, t in documents()]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("block_tokens", [3_000, 1 << 20])
def test_pack(spark, block_tokens):
    rows = [(i, t) for i, t in documents() if i is None or i != 5]
    rows += [(5000 + k, t) for k, t in enumerate(ODD)]
    docs = frame(spark, rows)
    settings = packing.Settings(length=256, block_tokens=block_tokens)
    got = packing.pack(docs, PATH, settings=settings).collect()
    whole = tokenizers.Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256
        total += at
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.08 * total
    for name, text in rows:
        if name is None:
            continue
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[name], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(pieces) == len({n for n, _ in rows})


def test_least_cost():
    rng = random.Random(2)
    for _ in range(60):
        places = np.array(sorted(rng.sample(range(1, 30), rng.randint(6, 12))), np.int64)
        if np.diff(np.concatenate([[0], places])).max() > 8:
            continue
        penalty = np.array([rng.choice([0, 2, 5]) for _ in places], np.int64)
        penalty[-1] = 0

        def cost(cuts):
            edges = [0, *cuts]
            sizes = [b - a for a, b in zip(edges, edges[1:])]
            if max(sizes) > 8:
                return None
            pad = [8 - s for s in sizes[:-1]] + [0 if sizes[-1] & (sizes[-1] - 1) == 0 else 8 - sizes[-1]]
            return sum(pad) + sum(int(penalty[places.tolist().index(c)]) for c in cuts)

        end = int(places[-1])
        options = [c for n in range(len(places)) for inner in itertools.combinations(places[:-1].tolist(), n) if (c := cost([*inner, end])) is not None]
        cuts = packing.best_cuts(places, penalty, 8, True, 1000)
        assert cost(cuts) == min(options)


def test_empty(spark):
    assert packing.pack(frame(spark, []).limit(0), PATH).count() == 0
