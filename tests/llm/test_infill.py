import hashlib
import re

from spanledger.llm import infill

TEXTS = [None, "", "a", "é", "<P>", "a <S> b", "plain <P text> <", "<<S", "S>M>", "word " * 5000 + "é", "?a?b", "ab?é😀cd", "one\ntwo\tthree", "x" * 70_000, "trailing <M"]


def brute_force(doc_id, text, rate=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(f"<{x}>" in text for x in "PSM") or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_row_against_brute_force_and_back(spark):
    ids = [None, 0, -5, *range(1, 60)]
    rows = [(i, t, "x", "y", "z") for i in ids for t in TEXTS] + [(7, "again and again", "x", "y", "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string, output string")
    out = infill.fill_in_middle(docs)
    got = out.withColumn("back", infill.restored(out["output"], out["form"])).collect()
    want = [(i, *brute_force(i, t), t or "") for i, t, *_ in rows]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_offsets_of_all_counts():
    for text in filter(None, TEXTS):
        units, tokens = infill.Units(text), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert units.n == len(tokens) and units.sentinel == any(f"<{x}>" in text for x in "PSM")
        at = 0
        for k, token in enumerate(["", *tokens]):
            at += len(token)
            assert units.offset(k) == at


def test_long_scans_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(infill, "_EVENTS", 4)
    for text in ("a b c d e f", "ab cd <P> ef", " a b c ", ""):
        assert infill.Units(text).n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
