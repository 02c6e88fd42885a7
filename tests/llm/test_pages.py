"""Web archives and main text on hand-made pages."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest

from parcelflow.llm import html_text, warc

PAGES = [
    (1, "http://a.b/1", "x" * 1500), (2, "http://a.b/2", "x" * 1500), (3, None, "small"), (4, "u r l\r\n", "small"), (5, "http://a.b/5", None),
    (6, "", ""), (7, "http://ä.b", "é WARC/1.1\r\n" * 200 + "\r\n\r\n"), (8, "h", "漢字" * 3000), (9, "h", "漢字" * 3000), (9, "h", "漢字" * 3000),
    (None, "h", "漢字" * 3000), (None, "n", "none"), (-5, "neg", "y" * 1000), (-6, "neg", "y" * 1000), (10, "z", "y" * 999), (11, "z", "y" * 999),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in "digest shared keeper payload host text uid value".split():
        df = df.selectExpr("*", f"1 as {name}")
    return df.repartition(3)


@pytest.mark.parametrize("segment, chunk", [(100, 7), (32_768, 8_192)])
def test_archives(spark, segment, chunk):
    got = warc.round_trip(pages(spark, PAGES), warc.Settings(segment_bytes=segment, chunk_bytes=chunk))
    payload = [(i, (h or "").encode()) for i, _, h in PAGES]
    want = Counter()
    for i, p in payload:
        same = [j for j, q in payload if q == p and j is not None]
        keeper = max(same) if same and len(p) >= 1000 else None
        revisit = keeper is not None and keeper != i
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_segments_are_verified(spark):
    columns = "type string, record_id string, refers string, digest string, row string, origin string, segment string, total string, block binary"
    first = ("response", "a", None, "sha1:0", "0", None, "1", None, b"12")
    last = ("continuation", "b", None, "sha1:0", "0", "a", "2", "4", b"34")
    whole = warc.reassemble(spark.createDataFrame([last, first], columns)).collect()
    assert b"".join(map(bytes, whole[0]["blocks"])) == b"1234"
    for broken in ([first], [last], [first, (*last[:7], "5", b"34")]):
        with pytest.raises(Exception):
            warc.reassemble(spark.createDataFrame(broken, columns)).collect()


def test_chunks():
    for data in (b"", b"a", "é漢".encode() * 50, b"WARC/1.1\r\n" * 9):
        for size in (1, 3, 1000):
            framed = warc.chunked(data, size)
            assert warc.unchunked(framed) == data
            assert b"WARC/1.1\r\n" not in framed
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><main><article><h1>Head &amp; line</h1><p>One
 &lt;two&gt;&nbsp;  three<br>four<p><b>Five<i> six</i></p><ul><li>seven<li>eight</ul><form>Mail <input></form><div class="ad">Buy</div>
<script>var t="</p>";</script><!-- no --><footer>Share</footer></article><section id="comments"><article>Reader says</article></section>
</main><footer>&copy; 2024</footer>"""


def test_structure():
    wrapped = '<div class="page-with-sidebar no-ads"><article>kept</article><div id="sidebar">side</div></div>'
    assert [t for _, t in html_text.blocks_of(wrapped)] == ["kept"]
    assert [t for _, t in html_text.blocks_of(ARTICLE)] == ["Head & line", "One <two> three four", "Five six", "seven", "eight"]


def test_class_words_do_not_hide_the_article():
    """Names mark parts of a page; an article, a sentence or a menu of dishes with such a name stays."""
    for html in (
        '<article class="post widget"><p>kept</p></article>',
        '<p class="comment-on-law">kept</p>',
        '<p>kept <span class="ad">with</span> all</p>',
        '<article><ul class="menu"><li>kept</ul></article>',
        '<article><h2 class="social-history">kept</h2></article>',
    ):
        assert html_text.blocks_of(html)[0][1].startswith("kept"), html
    assert html_text.blocks_of('<p>kept <span class="ad">with</span> all</p>') == [(0, "kept with all")]
    for html in ('<article class="comment-body"><p>r</p></article>', '<div class="site-footer">f</div>', '<p class="cookie-notice">c</p>', '<ul class="menu"><li>m</ul>'):
        assert html_text.blocks_of(html) == [], html


def test_no_part_inside_a_paragraph_comes_out():
    for html, want in (
        ("<p>see <select><option>o</option></select> end</p>", ["see", "end"]),
        ("<p>text <button><div>Buy now</div></button>", ["text"]),
        ("<p>text <button><p>Buy</p><p>now</p></button> end", ["text", "end"]),
        ("<p>text <noscript><div>n</div></noscript> end</p>", ["text", "end"]),
        ("<p>text <span class='share'><ul><li>tweet</ul></span> end</p>", ["text", "end"]),
        ("<p>one <b>two<div>three</div><p>four", ["one two", "three", "four"]),
    ):
        assert [t for _, t in html_text.blocks_of(html)] == want, html


def test_a_page_of_unmatched_tags_takes_time_in_proportion():
    took = []
    for n in (20_000, 100_000):
        start = time.process_time()
        assert html_text.blocks_of("<b>" * n + "</i>" * n + "end") == [(0, "end")]
        took.append(time.process_time() - start)
    assert took[1] < 15 * took[0]


def test_copies_of_an_article_are_no_template(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(i, f"http://h.x/{i}", f"<article><p>{long}</p></article>") for i in range(4)]
    rows += [(10 + i, f"http://k.x/{i}", "<p>It rained.") for i in range(5)]
    got = texts_of(spark, rows)
    assert got == {**{i: long for i in range(4)}, **{10 + i: "It rained." for i in range(5)}}


def test_main_text(spark):
    body = lambda i: f"<body><div>Home and News and Sport today</div><div>Story {i} about thing {i * 7}</div><div>All rights reserved by us for ever</div>"
    rows = [(i, f"http://h.x/{i}", body(i)) for i in range(5)]
    rows += [(10, "http://h.x/a", ARTICLE), (11, None, None), (12, "", ""), (None, "http://h.x/n", "<p>alone here"), (10, "http://h.x/a", ARTICLE)]
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(pages(spark, rows)).collect())
    article = "\n\n".join(t for _, t in html_text.blocks_of(ARTICLE))
    texts = [*(f"Story {i} about thing {i * 7}" for i in range(5)), article, "", "", "alone here", article]
    assert got == Counter((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts))
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_shards_agree(spark):
    body = lambda i: f"<div>Home and News and Sport today</div><div>Story {i} about thing {i * 7} and {i * 3}</div>"
    rows = pages(spark, [(i, f"http://h.x/{i}", body(i)) for i in range(40)])
    small = html_text.main_text(rows, html_text.Settings(shard_tokens=40)).select("page_id", "text").collect()
    assert all("Home" not in r["text"] and f"Story {r['page_id']} " in r["text"] for r in small)


def texts_of(spark, rows, **settings):
    return {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), html_text.Settings(**settings)).collect()}


def test_articles_meet_the_suffix_array(spark):
    """Template inside of articles goes when many pages share it; a teaser does not hide the story; copies stay."""
    terms = " ".join(f"term{k}" for k in range(30))
    story = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"http://h.x/{i}", f"<article><p>{story(i)} {terms}</p><p>Read more</p></article>") for i in range(6)]
    rows += [(6, "http://h.x/6", f"<article>Teaser six</article><div>{story(6)}</div>")]
    rows += [(i, f"http://h.x/{i}", f"<article>{story(7)}</article>") for i in (7, 8)]
    got = texts_of(spark, rows)
    assert got == {**{i: story(i) for i in range(6)}, 6: f"Teaser six\n\n{story(6)}", 7: story(7), 8: story(7)}


def test_common_phrases_stay_and_labels_go(spark):
    body = lambda i: f"<div>Home</div><div>n{i} at the end of the day m{i} at the end of the day</div><div>Read more</div>"
    got = texts_of(spark, [(i, f"http://h.x/{i}", body(i)) for i in range(9)])
    assert got == {i: f"n{i} at the end of the day m{i} at the end of the day" for i in range(9)}
    # Few of the host's pages, or one page several times, are no template.
    rows = [(i, f"http://h.x/{i}", f"<div>story {i}</div>" + "<div>again</div>" * (i < 3) + "<div>own</div>" * 5 * (i == 7)) for i in range(40)]
    got = texts_of(spark, rows)
    assert "again" in got[0] and got[7].count("own") == 5


def plain(rows, settings):
    """The definition by brute force."""
    parsed = [(i, u.split("/")[2], html_text.blocks_of(h)) for i, u, h in rows]
    size, out = settings.min_tokens, {}
    keys = []
    for _, _, blocks in parsed:
        t = [w for _, b in blocks for w in b.split(" ")]
        keys.append((t, [tuple(t[k : k + size]) for k in range(len(t) - size + 1)]))
    for (name, host, blocks), (tokens, windows) in zip(parsed, keys):
        # Pages of equal streams are one.
        same = list({tuple(b for _, b in p[2]): k for k, p in enumerate(parsed) if p[1] == host}.values())
        on = Counter(w for k in same for w in set(keys[k][1]))
        whole = Counter(b for k in same for b in {b for _, b in parsed[k][2]})
        often = lambda n, main: n >= settings.min_pages and n * 100 >= len(same) * (settings.main_percent if main else settings.open_percent)  # noqa: B023, E731
        kept, start = [], 0
        for role, b in blocks:
            n = len(b.split(" "))
            gone = [often(whole[b], role) or any(often(on[windows[j]], role) for j in range(max(0, k - size + 1), min(k + 1, len(windows)))) for k in range(start, start + n)]
            kept.append(" ".join(t for t, g in zip(tokens[start : start + n], gone) if not g))
            start += n
        out[name] = "\n\n".join(k for k in kept if k)
    return out


@pytest.mark.parametrize("shard_tokens", [1, 300, 2_000_000])
def test_stretches_against_brute_force(spark, shard_tokens):
    """Stretches across blocks, in windows of unlike neighbours, on few and many pages; the same whatever is sorted at once."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 60, n)]
    common = [word(n) for n in (7, 9, 12, 15, 30)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.integers(1, 7)):
            shared = common[rng.integers(0, 5)] if rng.random() < 0.5 else []
            low = rng.integers(0, 3)
            text = " ".join(word(rng.integers(0, 6)) + shared[low:] + word(rng.integers(0, 6)))
            parts.append(f"<article>{text}</article>" if rng.random() < 0.4 else f"<div>{text}</div>")
        rows.append((i, f"http://h{i % 3 if i % 2 else 0}.x/{i}", "".join(parts)))
    rows += [(100 + k, rows[k % 9][1], rows[k % 9][2]) for k in range(30)]
    settings = html_text.Settings(min_tokens=6, shard_tokens=shard_tokens)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), settings).collect()}
    want = plain(rows, settings)
    assert got == want and sum(len(t) for t in want.values()) < 0.9 * sum(len(t) for t in plain(rows, html_text.Settings(min_pages=99)).values())


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(30):
        tokens = rng.integers(0, 3, rng.integers(1, 60))
        got = html_text.suffix_array(tokens).tolist()
        assert got == sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())
