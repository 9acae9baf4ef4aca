import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import components, decontaminate, linededup, near_dedup, packing, pages, quality, substring, tokens, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, extra string, hash string"


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(100_000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows first (nulls, empty, repeats, one very long), then copies, near copies and a shared passage."""
    rng = random.Random(5)
    base, passage = words(rng, 200), words(rng, 70)
    near = base[:60] + ["changed"] + base[61:]
    fuzzy = passage[:30] + ["other"] + passage[31:]
    rows = [(None, "text without id"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, " ".join(words(rng, 30_000))), (5, "a b")]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(near)), (13, " ".join(words(rng, 100)))]
    rows += [(20, " ".join(words(rng, 50) + passage + words(rng, 50))), (21, " ".join(words(rng, 30) + fuzzy + words(rng, 40)))]
    rows += [(30, "A shared line here\nonly mine thirty"), (31, "other stuff words\n a SHARED line here \nend")]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_against_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        kept = [x for x in t.split("\n") if not (i is not None and len(holders.get(key(x), ())) > 1 and i != min(holders[key(x)]))]
        want.append((str(i), len(t.split("\n")), len(t.split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for limit, bits in ((1 << 20, 64), (0, 64), (1 << 20, 1), (0, 1)):  # by broadcast and by joins, without and with hashes that keys share
        got = [(str(r[0]), *r[1:]) for r in linededup.line_digests(docs, broadcast_bytes=limit, bits=bits).collect()]
        assert sorted(got) == sorted(want)
    assert linededup.line_digests(empty).count() == 0
    assert linededup.drop_repeated_lines(docs).columns == docs.columns


def test_long_lines_that_collide_modulo_powers_of_two_are_told_apart(spark):
    made = lambda n, flip: "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(n))
    docs = spark.createDataFrame([(1, "\n".join(made(n, 0) for n in (1024, 2048, 4096))), (2, made(2048, 0)), (3, "\n".join(made(n, 1) for n in (1024, 2048, 4096)))], "doc_id long, text string")
    for limit in (1 << 20, 0):
        assert {r["doc_id"]: r["n_dropped"] for r in linededup.line_digests(docs, broadcast_bytes=limit).collect()} == {1: 0, 2: 1, 3: 0}


def test_near_duplicates_against_brute_force(docs, empty):
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        if r["doc_id"] is not None and w:
            sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((parent[a], parent[b]))
                parent = {k: x if v == y else v for k, v in parent.items()}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"] in sets}
    assert got == parent and got[12] == 10 and got[5] == 3
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    assert {(r["node"], r["component"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_repeated_passages(docs, empty):
    found = {(r["doc_id"], r["source_id"]): r for r in substring.repeated_passages(docs).collect()}
    assert set(found) == {(11, 10), (12, 10), (21, 20)}
    r = found[21, 20]
    assert (r["start_word"], r["n_words"], r["source_start"]) == (30, 70, 50) and r["similarity"] == pytest.approx(69 / 70)
    assert substring.repeated_passages(empty).count() == 0


def test_chains_keep_order_and_pay_for_gaps():
    runs = np.array([[0, 0, 10], [12, 12, 10], [14, 500, 6], [28, 28, 9], [30, 5, 8]])
    assert substring.chains(runs)[0] == [0, 1, 3]


def test_decontamination_against_all_windows(spark, docs, empty):
    rng = random.Random(9)
    item = words(rng, 40)
    altered = item[:20] + ["zz"] + item[20:]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "never there")], "item_id long, text string")
    rows = spark.createDataFrame([(1, " ".join(words(rng, 30) + item + words(rng, 9))), (2, " ".join(words(rng, 90))), (3, " ".join(altered)), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontaminate.leaks(rows, items).collect()}
    assert got[1, 1] == (1.0, 30)

    def jaccard(a, b):
        return len(a & b) / len(a | b)

    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    best = max(jaccard(grams(altered[i : i + 40]), grams(item)) for i in range(2))
    assert ((3, 1) in got) == (best >= 0.8)
    assert {r["doc_id"] for r in decontaminate.decontaminate(rows, items).collect()} == {1, 2, 3, 4} - {i for i, _ in got}
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(empty, items).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    odd = spark.createDataFrame([(50, "tail space "), (51, "two  spaces\n\n x"), (53, "a <|endoftext|> b"), (54, "a<|endoftext|>b c<|endoftext|>"), (52, "<|endoftext|> é中 \t x")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").where("doc_id is not null").unionAll(odd)
    tokens.write_token_files(rows, str(tmp_path / "t"), tokens.default_tokenizer())
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in tokens.read_token_files(spark, str(tmp_path / "t")).collect())
    start = 0
    for (at, doc, ids), r in zip(got, sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"] or "")), strict=True):
        assert (at, doc, ids) == (start, r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [0])
        start += len(ids)
    tokens.write_token_files(empty, str(tmp_path / "e"), tokens.default_tokenizer())
    assert tokens.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_a_line_of_very_many_documents_beside_rare_ones(spark):
    """Beyond the broadcast, lines that most documents hold are sent to the tasks and others joined by a shuffle; the outcome is that of the broadcast."""
    rows = [(i, "a line that all documents hold" + (f"\nonly this one has it, number {i}" if i % 2 else "\na line of some documents" if i < 7 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, linededup.line_digests(docs).collect()))
    assert sorted(map(tuple, linededup.line_digests(docs, broadcast_bytes=31).collect())) == want
    keys = spark.createDataFrame([(i, h) for i in range(100) for h in ([7, 9] if i < 2 else [7])], "doc_id long, hash long")
    confirmed = spark.createDataFrame([(7, 0, 100), (9, 0, 2)], "hash long, first long, held long")
    for limit in (0, 16, 31, 10**6):
        got = linededup._drops(keys, confirmed, limit)
        assert got.count() == 102 and got.where("first <> 0").count() == 0
    joins = linededup._drops(keys, confirmed, 31)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in joins and joins.count("Union") == 1


def test_variable_length_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], dtype=np.uint32)
    assert (tokens.vbyte_decode(*tokens.vbyte_encode(values), len(values)) == values).all()


def test_packing_is_whole_and_tight(docs, empty):
    rows = packing.pack(docs, tokens.default_tokenizer()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(r["length"] for r in rows)
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len({(r["doc_id"], r["piece"]) for r in rows}) <= len(rows) and len(by) <= -(-total // 1024) + 1
    blank = next(r for r in rows if r["doc_id"] == 1)
    assert blank["length"] == 1 and blank["ids_crc32"] == zlib.crc32(np.array([2], dtype="<u4").tobytes())
    assert packing.pack(empty, tokens.default_tokenizer()).count() == 0


@pytest.mark.parametrize("n", [1000, 4096])
def test_the_genetic_search_needs_fewer_bins_than_best_fit(n):
    rng, fewer = np.random.default_rng(0), 0
    for k in range(5):
        sizes = np.sort(np.clip(np.exp(rng.normal(6.0, 0.9, n)).astype(int) % 1024, 1, 1023))[::-1].copy()
        bins, rooms = [], []
        packing.best_fit(sizes.tolist(), list(range(n)), bins, rooms, 1024)
        of = np.frombuffer(packing.evolve(sizes, [], (k, 0, 0), 1024)[0], dtype="<i4")
        assert len(of) == n and np.bincount(of, weights=sizes).max() <= 1024
        assert -(-int(sizes.sum()) // 1024) <= of.max() + 1 <= len(bins)
        fewer += len(bins) - of.max() - 1
    assert fewer > 1


def test_crossover_and_migration_alone_need_fewer_bins(monkeypatch):
    """Without the step that fills bins anew: crosses between islands against best fit, and against as many starts that are never crossed."""
    monkeypatch.setattr(packing, "relieve", lambda sizes, solution, capacity, least, rng: solution)

    def fewer(children):
        monkeypatch.setattr(packing, "CHILDREN", children)
        won = []
        for k in range(5):
            rng = np.random.default_rng(k)
            a = rng.integers(260, 500, 200)
            b = (1024 - a) // 2 + rng.integers(-60, 60, 200)
            sizes = np.sort(np.concatenate([a, b, 1024 - a - b]))[::-1].copy()  # three to a bin
            bins, rooms = [], []
            packing.best_fit(sizes.tolist(), list(range(600)), bins, rooms, 1024)
            islands = [[] for _ in range(3)]
            for number in range(2):
                islands = [packing.evolve(sizes, own, (k, i, number), 1024) for i, own in enumerate(islands)]
                islands = [own[:3] + [islands[i - 1][0]] for i, own in enumerate(islands)]
            won.append(len(bins) - min(int(np.frombuffer(own[0], dtype="<i4").max()) + 1 for own in islands))
        return won

    crossed, alone = fewer(packing.CHILDREN), fewer(0)
    assert min(crossed) >= 1 and sum(crossed) > sum(alone) and all(x >= y for x, y in zip(crossed, alone))


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 300)
    best = packing.evolve(sizes, [], (1, 0, 0), 1024)[0]
    of = np.frombuffer(best, dtype="<i4")
    assert len(of) == 300 and max(np.bincount(of, weights=sizes)) <= 1024


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows = [(i, ". ".join(" ".join(words(rng, 8)) for _ in range(6)) + (". you vile wretch" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert held and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[1000]["score"] == 0 and rows[3][1][got[3]["worst_start"] : got[3]["worst_end"]].strip() == "you vile wretch"
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] for i, r in got.items())
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).words.size == 0


def test_quality_counts(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert (got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (0, True, False)
    assert got[4]["n_words"] == 30_000 and not got[4]["base_failed"]
    assert quality.judge_quality(empty).count() == 0


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<p>", ""),
    ("<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One &amp; two\n three.</p><p>Four five six.</p></article><footer>Foot</footer></body></html>", "Title\nOne & two three.\nFour five six."),
])
def test_main_text(html, want):
    assert pages.main_text(html) == want


def test_url_filter_is_as_of_the_fetch(spark):
    captures = spark.createDataFrame([(1, "http://a.x.org/p/q", "2024-01-05"), (2, "http://a.x.org/p/q", "2024-03-05"), (3, "HTTP://b.x.org:80/", "2024-03-05"), (4, None, "2024-03-05"), (5, "nothing", None)], "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast("timestamp"))
    entries = spark.createDataFrame([("bad", "host", "A.x.org", "add", "2024-01-01"), ("bad", "host", "a.x.org", "remove", "2024-02-01"), ("odd", "domain", "x.org", "add", "2024-03-05"), ("allow", "prefix", "b.x.org", "add", "2023-01-01"), ("bad", "host", None, "add", "2024-01-01")], "list string, kind string, pattern string, action string, at string").withColumn("listed_at", F.col("at").cast("timestamp"))
    got = {r["page_id"]: (r["lists"], r["blocked"]) for r in urlfilter.filter_urls(captures, entries).collect()}
    assert got == {1: (["bad"], True), 2: (["odd"], True), 3: (["allow", "odd"], False), 4: ([], False), 5: ([], False)}
    assert urlfilter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


def test_pipeline_keeps_its_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rooms_of_stored_packings_are_counted_for_all_bins_at_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 500)
    bins, rooms = [], []
    packing.best_fit(sizes.tolist(), list(range(500)), bins, rooms, 1024)
    again = packing._solution(sizes, packing._assigned(bins), 1024)
    assert again == (bins, rooms) and all(type(r) is int for r in again[1])
    fewer = packing.relieve(sizes.tolist(), (bins, rooms), 1024, 0, rng)
    assert fewer[1] == [1024 - sum(sizes[i] for i in x) for x in fewer[0]]
