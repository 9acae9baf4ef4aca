"""Trees of spans against walks of them, one span at a time."""

import random

from spanledger.operators import ancestry

SCHEMA = "trace_id string, span_id long, parent_id long, started_us long, ended_us long, sequence_index int"


def _walked(rows):
    """{span: (row, depth, spans below)} of one trace, from a stack."""
    rows = sorted(rows, key=lambda r: (r[3], r[5], r[1]))
    kids, ids, seen, out = {}, {r[1] for r in rows}, set(), []
    for r in rows:
        kids.setdefault(r[2], []).append(r[1])
    for start in [r[1] for r in rows if r[2] not in ids] + [r[1] for r in rows]:
        stack = [(start, 0)]
        while stack:
            span, depth = stack.pop()
            if span not in seen:
                seen.add(span)
                out.append((span, depth))
                stack += [(k, depth + 1) for k in reversed(kids.get(span, []))]
    found = {}
    for i, (span, depth) in enumerate(out):
        below = next((j for j in range(i + 1, len(out)) if out[j][1] <= depth), len(out)) - i - 1
        found[span] = (i, depth, below)
    return found


def _depth(span, parents):
    seen = {span}
    while parents.get(span) in parents and parents[span] not in seen:
        span = parents[span]
        seen.add(span)
    return len(seen) - 1


def _made(n_traces, rng):
    """Traces with any parents: trees, orphans, spans that are their own parent, cycles with tails, ties of starts."""
    rows = []
    for t in range(n_traces):
        n = rng.randint(1, 25)
        for i in range(n):
            parent = rng.choice([None, i, n + 5, *[rng.randrange(n) for _ in range(9)]]) if t % 2 else rng.choice([None, *([rng.randrange(i)] * 9 if i else [])])
            start = rng.randrange(6)
            rows.append((f"t{t}", i, parent, start, rng.choice([None, start + rng.randrange(9)]), rng.randrange(2)))
    return rows


def test_trees_and_cycles_equal_walks(spark):
    rows = _made(60, random.Random(5))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tree = {(r["trace_id"], r["span_id"]): r for r in ancestry.waterfall(frame).collect()}
    depths = {(r["trace_id"], r["span_id"]): r["depth"] for r in ancestry.with_depth(frame).collect()}
    assert len(tree) == len(depths) == len(rows)
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        parents, walked = {r[1]: r[2] for r in own}, _walked(own)
        for span, expected in walked.items():
            r = tree[t, span]
            assert (r["row"], r["depth"], r["n_below"]) == expected, (t, span)
            assert r["has_children"] == (span in parents.values()) and r["is_orphan"] == (parents[span] is not None and parents[span] not in parents)
            assert depths[t, span] == _depth(span, parents), (t, span)


def test_a_deep_chain_takes_rounds_by_its_logarithm(spark):
    rows = [("t", i, i - 1 if i else None, i, i + 1, 0) for i in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert all(r["depth"] == r["row"] == r["span_id"] and r["n_below"] == 699 - r["span_id"] for r in ancestry.waterfall(frame).collect())


def test_spans_sent_twice_and_no_spans(spark):
    twice = spark.createDataFrame([("t", 1, None, 0, 9, 0), ("t", 2, 1, 3, 4, 0), ("t", 2, None, 1, 2, 0)], SCHEMA)
    assert {(r["span_id"], r["depth"], r["row"]) for r in ancestry.waterfall(twice).collect()} == {(1, 0, 0), (2, 0, 1)}
    none = spark.createDataFrame([], SCHEMA)
    assert ancestry.waterfall(none).count() == 0 and ancestry.with_depth(none).count() == 0


def test_short_traces_take_no_joined_rounds_and_longer_ones_do(spark, monkeypatch):
    frame = spark.createDataFrame(_made(30, random.Random(6)), SCHEMA).repartition(3)

    def found():
        tree = {tuple(r) for r in ancestry.waterfall(frame).select("trace_id", "span_id", "depth", "row", "n_below").collect()}
        return tree, {(r["trace_id"], r["span_id"], r["depth"]) for r in ancestry.with_depth(frame).collect()}

    monkeypatch.setattr(ancestry, "WHOLE", 12)
    mixed = found()
    monkeypatch.setattr(ancestry, "WHOLE", 10_000)
    monkeypatch.setattr(ancestry, "_rounds", lambda *_: 1 / 0)
    assert found() == mixed
