import random
import re

import numpy as np
import pytest

from spanledger.llm import prefix_join

SCHEMA = "doc_id long, text string, key string, n string, component string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_force(rows, k, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    full = [(i, s) for i, s in sets if s and i is not None]
    for a, (i, x) in enumerate(full):
        for j, y in full[:a]:
            if 100 * len(x & y) >= percent * len(x | y) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    """Odd rows, copies, chains of near copies, one large group of near copies and a template that many documents fill in."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(None, "no id at all here"), (1, None), (2, ""), (3, " \t "), (4, "a b"), (5, "A B"), (6, "a b c"), (6, "a b"), (7, "x y z w"), (7, "other words stand in this row")]
    add = lambda words: rows.append((len(rows) * 3 + 10, " ".join(words)))
    for _ in range(25):  # chains: neighbours are alike, ends may not be
        words = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(5):
            add(words)
            words = edited(rng, words, max(1, len(words) // 60))
    base = [word() for _ in range(150)]
    for _ in range(90):
        add(edited(rng, base, rng.choice([0, 1, 2, 3, 4])))
    template = [word() for _ in range(100)]
    for _ in range(60):  # about 0.75 to 0.9 alike
        add(template + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 9, 12]))])
    add([word() for _ in range(20_000)])
    add(rows[-1][1].split()[:-300])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,share,percent,k", [(256, 100_000, 85, 4), (5, 3, 85, 4), (16, 100_000, 80, 5)])
def test_groups_against_all_pairs(spark, rows, monkeypatch, block, share, percent, k):
    monkeypatch.setattr(prefix_join, "BLOCK", block)
    monkeypatch.setattr(prefix_join, "SHARE", share)
    monkeypatch.setattr(prefix_join, "SMALL", min(64, block // 2))
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = prefix_join.similar_groups(docs, k, percent).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_force(rows, k, percent)


def test_second_round_finds_what_the_first_does_not(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_join, "BLOCK", 4)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    monkeypatch.setattr(prefix_join, "_first_round", lambda prefix, *_: spark.createDataFrame([], "u long, v long"))
    got = prefix_join.similar_groups(docs, 4, 85).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_force(rows, 4, 85)


def test_empty_table(spark):
    assert prefix_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_against_all_pairs_and_prunes():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 100):
        base = np.sort(rng.choice(400, 60, replace=False))
        lists = [np.unique(np.where(rng.random(60) < 0.15, rng.integers(0, 400, 60), base)) for _ in range(50)] + [base, base, base[:30]]
        weight = rng.integers(1, 5, 401)
        n = np.array([weight[x].sum() + rng.integers(0, 8) for x in lists])
        trie = prefix_join.Trie(lists, [weight[x] for x in lists], n)
        overlap = np.zeros((len(lists), 401), dtype=np.int64)
        for q, x in enumerate(lists):
            overlap[q, x] = weight[x]
        found = sorted(trie.search(overlap, np.cumsum(overlap[:, ::-1], axis=1)[:, ::-1], n, percent))
        both = lambda a, b: int(weight[np.intersect1d(lists[a], lists[b])].sum())
        assert found == sorted((a, b) for a in range(len(lists)) for b in range(len(lists)) if 100 * both(a, b) >= percent * (n[a] + n[b] - both(a, b)))
