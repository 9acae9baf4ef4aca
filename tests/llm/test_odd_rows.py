"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from spanledger.llm import decontaminate, linededup, pages, toxicity, urlfilter

PARAGRAPH = "Plain words of a paragraph that goes on for quite a while, long enough to count as the text of the page."


def test_documents_left_without_a_word_go_only_if_asked(spark):
    rows = [(1, "one shared line\nanother shared line", "a"), (2, " one shared line \n another SHARED line", "b"), (3, None, "c"), (4, "", "d"), (5, "one shared line\nown", "e"), (None, "one shared line", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = {r["hash"]: r["text"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert kept == {"a": rows[0][1], "b": "", "c": None, "d": "", "e": "own", "f": "one shared line"}
    for limit in (linededup.BROADCAST_BYTES, 0):
        kept = {r["hash"]: r["text"] for r in linededup.drop_repeated_lines(docs, emptied=False, broadcast_bytes=limit).collect()}
        assert kept == {"a": rows[0][1], "c": None, "d": "", "e": "own", "f": "one shared line"}


def test_a_column_with_the_name_of_the_joined_one_is_refused(spark):
    docs = spark.createDataFrame([(1, "a line of words", 1), (2, "a line of words", 2)], f"doc_id long, text string, {linededup.DROPPED} int")
    with pytest.raises(ValueError):
        linededup.drop_repeated_lines(docs, broadcast_bytes=0)


@pytest.mark.parametrize("broadcast_rows", [urlfilter.BROADCAST_ROWS, 0])
def test_url_filter_odd_rows_on_both_paths(spark, broadcast_rows):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    entries = spark.createDataFrame(
        [("bad", "domain", "x.org", "add", day(0)), ("bad", "domain", "x.org", "remove", day(5)), ("bad", "domain", "x.org", "add", day(5)), ("bad", "domain", "x.org", "add", day(9)), ("bad", "host", None, "add", day(0)), ("bad", "host", "y.org", "other", day(0))],
        "list string, kind string, pattern string, action string, listed_at timestamp",
    )
    rows = [(1, "http://a.x.org/p", day(1)), (1, "http://a.x.org/p", day(1)), (2, "http://x.org", day(5)), (3, "http://x.org", day(9)), (4, None, day(1)), (5, "", day(1)), (6, "http://x.org", None), (7, "http://y.org", day(1)), (None, "http://x.org/" + "a/" * 3000, day(2))]
    captures = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, fetched_at timestamp, kind string, period int")
    got = sorted((str(r["page_id"]), r["n_hits"], r["blocked"]) for r in urlfilter.filter_urls(captures, entries, broadcast_rows=broadcast_rows).collect())
    # of an add and a removal at one time the removal counts
    assert got == sorted([("1", 1, True), ("1", 1, True), ("2", 0, False), ("3", 1, True), ("4", 0, False), ("5", 0, False), ("6", 0, False), ("7", 0, False), ("None", 1, True)])
    assert urlfilter.filter_urls(captures.limit(0), entries, broadcast_rows=broadcast_rows).count() == 0


def test_pages_odd_rows(spark):
    inline = f"<html><head><style>x</style></head><body><nav>Menu</nav><article><p>{PARAGRAPH} <script>var x = 1;</script>It<span hidden>no</span> goes on<button>Share</button>.</p><p><span class='ad'>Buy</span>{PARAGRAPH}</p></article><footer>Foot</footer></body></html>"
    long = "<article>" + f"<p>{PARAGRAPH}</p>" * 5000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", inline), (4, "u", inline), (4, "u", inline), (5, "u", long), (6, "u", "<p>unclosed <b>text"), (7, "u", "<![CDATA[ <p> &amp; & &#x41;"), (8, "u", "\x00<p>" + PARAGRAPH)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = pages.extract(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[5] == "\n".join([PARAGRAPH] * 5000)
    assert by[4] == by[None] == f"{PARAGRAPH} It goes on.\n{PARAGRAPH}"
    assert pages.extract(frame.limit(0)).count() == 0


def plain_paragraphs(html):
    """The paragraphs of pages made below, by splitting at tags: a plain reference for these pages only."""
    import re

    body = re.search(r"<main>(.*)</main>", html, re.S).group(1)
    body = re.sub(r"<(script|style|button)\b.*?</\1>|<span hidden>.*?</span>|<span class='ad'>.*?</span>", "", body, flags=re.S)
    return "\n".join(" ".join(re.sub(r"<[^>]+>", "", p).split()) for p in re.findall(r"<p>(.*?)</p>", body, re.S))


def test_pages_against_a_plain_extractor(spark):
    rng, rows = random.Random(2), []
    noise = ["<script>if (a < b) { x('</p') }</script>", "<style>p { color: red }</style>", "<button>Share this</button>", "<span class='ad'>Buy now</span>", "<span hidden>secret</span>", ""]
    for k in range(40):
        paragraphs = ["".join(f"{' '.join(rng.choice(['river', 'stone', 'cloud', 'paper', 'light']) for _ in range(rng.randrange(8, 40)))} {rng.choice(noise)} " for _ in range(3)) for _ in range(rng.randrange(2, 8))]
        html = f"<html><head><title>T</title></head><body><header><nav><ul><li><a href=/>Home</a></li></ul></nav></header><main>{''.join(f'<p>{p}</p>' for p in paragraphs)}</main><aside><p>Other things</p></aside><footer>Imprint</footer></body></html>"
        rows.append((k, "u", html))
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: plain_paragraphs(html) for k, _, html in rows}


def test_toxicity_odd_rows(spark):
    rng = random.Random(1)
    say = lambda bad: ". ".join(" ".join(rng.choice(["you", "the", "is", "tree", "house", "idiot" if bad else "garden"]) for _ in range(8)) for _ in range(4))
    rows = [(i, say(i % 3 == 0), i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(None, "idiot " * 9, "x", 1.0), (900, None, "x", 1.0), (901, "", "x", 1.0), (902, "?! ..", "x", 1.0), (903, "idiot idiot. " * 20_000, "x", 1.0), (3, rows[3][1], "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 306 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] == 0 and by[900]["worst_start"] is None
    assert by[903]["predicted"] == 1 and not by[None]["held_out"] and len({r["score"] for r in out if r["doc_id"] == 3}) == 1
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held) > 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 903").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} <= {0, 1}


def test_decontamination_odd_rows(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, long = words(50), words(5000)
    rows = [(1, None), (2, ""), (3, " ".join(words(3))), (4, " ".join(words(20) + item + words(20))), (4, " ".join(words(20) + item + words(20))), (None, " ".join(item)), (5, " ".join(words(40_000) + item)), (6, " ".join(item[:25])), (7, " ".join(words(9) + long + words(9)))]
    docs = spark.createDataFrame([(*r, "i", 1) for r in rows], "doc_id long, text string, item_id string, similarity int")
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, " ".join(long)), (None, "a b c d e f g h")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(4, 1), (None, 1), (5, 1), (7, 4)}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6]


def test_decontamination_finds_every_altered_window(spark):
    """Brute force: the best window of an item's size by the similarity of the multisets of five-word shingles."""
    from collections import Counter

    rng = random.Random(11)
    items = {k: [f"i{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 90))] for k in range(30)}
    docs, want, near = [], set(), set()
    for k, item in items.items():
        for j in range(4):
            altered = list(item)
            for at in rng.sample(range(len(item)), j):
                altered[at] = f"x{rng.randrange(10**6)}"
            text = [f"d{rng.randrange(10**6)}" for _ in range(30)] + altered + [f"d{rng.randrange(10**6)}" for _ in range(30)]
            docs.append((10 * k + j, " ".join(text)))
            grams = lambda w: Counter(zip(*(w[i:] for i in range(5))))
            a = grams(item)
            best = max((sum((a & b).values()) / sum((a | b).values()) for b in (grams(text[i : i + len(item)]) for i in range(len(text) - len(item) + 1))), default=0)
            (want if best >= 0.8 else near if best >= 0.7 else set()).add((10 * k + j, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")).collect()}
    # windows of the other items' sizes are compared too, and a shorter one may be more like the item
    assert want <= got <= want | near and len(want) > 30
