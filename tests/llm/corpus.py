"""A small hostile corpus, and the documents as frames."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ne ru ta vo shi pe du".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def documents() -> list[tuple[int | None, str | None]]:
    """Ids and texts: copies, near copies, shared passages, hot lines, odd white space, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(7)
    line = " ".join(words(rng, 12))
    passage = " ".join(words(rng, 60))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(120):
        own = words(rng, rng.randint(1, 150))
        text = " ".join(own)
        if i % 3 == 0:
            text = line + "\n" + text
        if i % 7 == 0:
            text = text + " " + passage + " " + " ".join(words(rng, 5))
        rows.append((i, text))
    rows.append((125, rows[3][1]))
    for i in range(130, 160):  # near copies of one text
        near = rows[7][1].split(" ")
        near[rng.randrange(len(near))] = f"edit{i}"
        rows.append((i, " ".join(near)))
    rows += [(200 + k, rows[21][1]) for k in range(15)]  # exact copies
    rows += [
        (300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "one two"), (305, "ONE two"), (306, "a b  c é\x1c d"),
        (307, "x " * 400), (308, "é" * 300), (309, "\x00\x00zero\x00" * 40), (310, "\x00\x00zero" * 40),
        (None, rows[5][1]), (None, "only here " + " ".join(words(rng, 40))), (5, rows[5][1]), (5, rows[5][1]),
        (-4, passage), (311, " ".join(words(rng, 9000)) + " " + passage),
    ]
    return rows


def frame(spark, rows, extra: bool = True):
    """The rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in "block uid n tokens bucket score words kind ids data hot m url page_id".split():
            df = df.selectExpr("*", f"'x' as {name}")
    return df.repartition(4)
