"""The pipeline on a small corpus with planted cases, each stage held against a brute-force version on its own input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanledger.llm import decontaminate, linededup, near_dedup, tokens

SCHEMA = "doc_id long, text string, source string, n_chars long, hash string"
SPACE = " \t\n\v\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, stem="w"):
    """Lines of ten words, no two of them alike."""
    made = [f"{stem}{rng.randrange(1_000_000)}" for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 10]) + "." for i in range(0, n, 10))


def corpus():
    """Rows, labels, benchmark items; the planted ids by kind."""
    rng = random.Random(17)
    rows, labels, kinds = [], [], {}

    def add(i, text, kind="plain", toxic=0):
        rows.append((i, text, "s", None if text is None else len(text), f"h{i}"))
        kinds.setdefault(kind, set()).add(i)
        if i is not None:
            labels.append((i, toxic))

    for i in range(100, 300):
        if i % 3:
            add(i, prose(rng, 60))
        else:
            add(i, prose(rng, 30) + "\nyou vile wretch of filth.\n" + prose(rng, 30), "toxic", 1)
    whole = prose(rng, 120)
    for i in (400, 401, 402):
        add(i, whole, "copy")
    # near copies on one line each, as shared lines would be gone before this stage
    base = prose(rng, 200).replace("\n", " ").split(" ")
    for i, at in ((410, None), (411, 60), (412, 150)):
        add(i, " ".join(base if at is None else base[:at] + ["changed"] + base[at + 1 :]), "near")
    add(413, " ".join(base[:110] + prose(rng, 90).replace("\n", " ").split(" ")), "half alike")
    items = [prose(rng, 40, "b").replace("\n", " ") for _ in range(3)]
    fuzzy = items[1].split(" ")
    fuzzy[3] = "other"
    add(420, prose(rng, 60) + "\n" + items[0] + "\n" + prose(rng, 60), "leak")
    add(421, prose(rng, 60) + "\n" + " ".join(fuzzy) + "\n" + prose(rng, 60), "leak")
    add(422, prose(rng, 60) + "\n" + " ".join(items[2].split(" ")[:15]), "part of an item")
    add(430, prose(rng, 30) + "\nA line that two documents hold\n" + prose(rng, 30), "shared line")
    add(431, prose(rng, 30) + "\n  a LINE that two documents hold \n" + prose(rng, 30), "shared line")
    add(440, prose(rng, 4000), "long")
    again = prose(rng, 50)
    for i, text in ((1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "text without an id at all"), (450, again), (450, again)):
        add(i, text, "odd")
    return rows, labels, items, kinds


def clean_rows(rows, labels):
    toxic = {i for i, y in labels if y}
    return [r for r in rows if r[0] not in toxic]


def line_dedup(rows):
    key = lambda line: lower(line.strip(SPACE))
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= linededup.MIN_CHARS:
                holders.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or r[0] == min(holders.get(key(x), {r[0]}))]
        if len(kept) == len(lines):
            out.append(r)
        elif "\n".join(kept).strip(SPACE):
            text = "\n".join(kept)
            out.append((r[0], text, r[2], len(text), r[4]))
    return out


def one_of_each_group(rows):
    sets = {}
    for r in rows:
        w = [x for x in lower(r[1] or "").split()]
        if r[0] is not None and w:
            k = near_dedup.SHINGLE
            sets[r[0]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    least = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= near_dedup.PERCENT * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    return [r for r in rows if least.get(r[0], r[0]) == r[0]]


def without_items(rows, items):
    k = decontaminate.SHINGLE
    counted = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))

    def leaks(text):
        w = lower(text or "").split()
        for item in items:
            own = lower(item).split()
            want = counted(own)
            for at in range(max(1, len(w) - len(own) + 1)) if w else ():
                have = counted(w[at : at + len(own)])
                if (have & want).total() >= decontaminate.SIMILARITY * (have | want).total():
                    return True
        return False

    return [r for r in rows if not leaks(r[1])]


def pieces(rows):
    library = Tokenizer.from_file(tokens.default_tokenizer())
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((r[0], p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    return out


def best_fit(sizes):
    """Sequences that best fit needs, longest piece first."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        room = min((x for x in rooms if x >= size), default=None)
        if room is not None:
            rooms.remove(room)
        rooms.append((1024 if room is None else room) - size)
    return len(rooms)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items, _ = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, tables, tmp_path):
    rows, labels, items, kinds = corpus()
    plain = {"toxicity": lambda r: clean_rows(r, labels), "line dedup": line_dedup, "near dedup": one_of_each_group, "decontamination": lambda r: without_items(r, items), "packing": pieces}
    docs, at_hand, left = spark.read.parquet(f"{tables}/documents.parquet"), rows, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        want = plain[name](at_hand)
        if name == "packing":
            packed = out
            break
        assert out.columns == docs.columns, name
        assert ordered(out.collect()) == ordered(want), name
        out.write.parquet(f"{tmp_path}/{n}")
        docs, at_hand = spark.read.parquet(f"{tmp_path}/{n}"), want
        left[name] = {r[0] for r in want}
    ids = {r[0] for r in rows}
    assert kinds["toxic"] and ids - left["toxicity"] == kinds["toxic"]
    assert left["toxicity"] - left["line dedup"] == {401, 402}
    assert left["line dedup"] - left["near dedup"] == {411, 412}
    assert left["near dedup"] - left["decontamination"] == {420, 421}

    got = packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    same = lambda r: (r[0], r[1], r[2], r[3], r[4])
    assert ordered(map(same, got)) == ordered(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert -(-sum(r["length"] for r in got) // 1024) <= len(held) <= best_fit(r["length"] for r in got)
    whole = corpus_pipeline.run(spark, tables).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert ordered(whole) == ordered(want)


def test_no_documents_give_no_rows(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
