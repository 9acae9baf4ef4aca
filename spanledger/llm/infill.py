"""Fill-in-the-middle transformation of documents, cut at unit bounds that an Aho-Corasick event scan locates.

A unit is a run of ASCII letters or any other single code point. Each code point outside ASCII is one unit, as '?' is,
so a text with '?' in their place has the same units at the same offsets. One automaton reports where a run of letters
begins or ends: its patterns are the pairs of ASCII characters in which the second changes the class (letter or not)
and the three sentinels, over an alphabet that is folded to the characters of the sentinels, any other letter and
anything else. Between two events the number of units is arithmetic: one for a run of letters, the number
of code points for a gap. The events are thus enough to look up the offset that lies after any count of units.
"""

from __future__ import annotations

import hashlib
import string
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that are transformed, and of these with the suffix first.
RATE, SUFFIX_FIRST = 90, 20

#: ASCII bytes as the scan sees them.
_FOLDED = bytes(i if chr(i) in PREFIX + SUFFIX + MIDDLE else ord("a" if chr(i) in string.ascii_letters else " ") for i in range(256))
_EVENTS = 1 << 20  # taken from the scan at a time
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    letters, others = ([c for c in set(_FOLDED.decode()) if c.isalpha() == kind] for kind in (True, False))
    for pattern in [PREFIX, SUFFIX, MIDDLE, *(a + b for a in letters for b in others), *(b + a for a in letters for b in others)]:
        found.add_word(pattern, len(pattern))
    found.make_automaton()
    return found


def letter_runs(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where the runs of ASCII letters of a text begin and end, and whether it holds a sentinel."""
    plain = text.encode("ascii", "replace").translate(_FOLDED).decode("ascii")
    events, parts = map(itemgetter(0), automaton().iter(plain)), []
    while True:
        parts.append(np.fromiter(islice(events, _EVENTS), np.int64))
        if len(parts[-1]) < _EVENTS:
            break
    at = np.concatenate(parts)
    # a sentinel ends where its letter's run has just ended: the one place with two events
    distinct = np.ones(len(at), dtype=bool)
    distinct[1:] = at[1:] != at[:-1]
    sentinel, at = not distinct.all(), at[distinct]
    if plain[:1].isalpha():
        at = np.concatenate(([0], at))
    if plain[-1:].isalpha():
        at = np.concatenate((at, [len(plain)]))
    return at[::2], at[1::2], sentinel


class Units:
    """The units of one text: how many there are, and the code point at which each count of them ends."""

    def __init__(self, text: str):
        self.starts, self.ends, self.sentinel = letter_runs(text)
        #: code points that the runs before each run have beyond one each
        self.saved = np.concatenate(([0], np.cumsum(self.ends - self.starts - 1)))
        self.n = len(text) - int(self.saved[-1])

    def offset(self, count: int) -> int:
        """Code points in the first `count` units."""
        return count + int(self.saved[np.searchsorted(self.starts - self.saved[:-1], count)])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that follow from seed and doc_id; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transform(doc_id: int | None, text: str, seed: int, rate: int, suffix_first: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    units, (h1, h2, h3, h4) = Units(text), draws(doc_id, seed)
    if not text or units.sentinel or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    a, b = (units.offset(x) for x in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each document as prefix, suffix and middle behind their sentinels.

    docs(doc_id, text). Returns a row per row: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars
    (code points; null if plain) and output. The cuts follow from seed and doc_id alone; a null doc_id counts as one
    without digits, so all such rows draw alike. A null or empty text, one that holds a sentinel, and rows beyond `rate`
    per cent stay plain. Repeated rows give equal rows, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        names = [c.split()[0] for c in _OUT.split(", ")]
        for part in slices(batches):
            rows = [transform(i, t or "", seed, rate, suffix_first) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([part.column("doc_id"), *columns], names=names)

    return id_text(docs).mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that gave this output: no sentinel stands in it, so the first of each kind is the one put there."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    last, first, between = pieces(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, between, last)).otherwise(output)
