"""Numbers, dates and names of the evaluators, as columns."""

from __future__ import annotations

import difflib
import math
import re
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def inverse_erf(x: float) -> float:
    return normal_quantile((x + 1) / 2) / math.sqrt(2)


def log_choose(n: Column, k: Column) -> Column:
    """The logarithm of a binomial coefficient, summed in order."""
    logs = lambda m: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m.cast("long"), F.lit(1).cast("long"))), F.lit(0.0), lambda a, x: a + F.log(x.cast("double")))
    return logs(n) - logs(k) - logs(n - k)


def count_or_null(text: Column) -> Column:
    """A whole number that isn't negative, or null."""
    n = text.try_cast("long")
    return F.when(n >= 0, n)


def cost_or_null(text: Column) -> Column:
    """A decimal that isn't negative, or null."""
    n = text.try_cast("decimal(18,8)")
    return F.when(n >= 0, n)


def rounded_even(x: Column, digits: int = 4) -> Column:
    """Half-way cases go to the even digit."""
    return F.bround(x, digits)


def weighted(parts: dict[str, float]) -> Column:
    """The weighted mean of columns that aren't null, null without any."""
    given = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise(0.0)
    total = sum((given(c, F.lit(float(w))) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(sum((given(c, F.col(c) * float(w)) for c, w in parts.items()), F.lit(0.0)), total)


def mastery(right: Column, asked: Column, prior: float = 0.5, weight: float = 2.0) -> Column:
    """The mean of a Beta posterior: a prior of some weight and the answers."""
    return (prior * weight + right) / (weight + asked)


def expected_calls(n: Column, rate: Column, failing: Column) -> Column:
    """Paid calls to expect: those sampled, and failures among the others."""
    return n * rate + n * failing * (1 - rate)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def month_start(at: Column) -> Column:
    return F.date_trunc("month", at)


def month_end(at: Column) -> Column:
    """The first moment of the next month."""
    return F.date_trunc("month", at) + F.expr("interval 1 month")


def month_of_partition(name: Column) -> Column:
    """The month of a partition's name that ends in _yyyy_mm, or null."""
    found = F.regexp_extract(name, r"_(\d{4}_(?:0[1-9]|1[0-2]))$", 1)
    return F.when(found != "", F.to_date(F.concat(found, F.lit("_01")), "yyyy_MM_dd"))


def age_seconds(at: Column, now: Column) -> Column:
    """Seconds since a moment, 0 for one in the future, null for none."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 1e6)


def from_nanos(nanos: Column) -> Column:
    """A moment from nanoseconds since 1970, that time itself where they are no number."""
    n = nanos.try_cast("decimal(20,0)")
    micros = F.floor(n / 1000).try_cast("long")
    return F.coalesce(F.timestamp_micros(F.when(micros >= 0, micros)), F.lit(EPOCH).cast("timestamp"))


def iso_dates(text: Column) -> Column:
    """The dates in a text written as yyyy-mm-dd."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), 1), lambda d: d.try_cast("date")), lambda d: d.isNotNull())


#: Phrases and the days they mean from the day on.
PHRASES = {"today": 0, "tomorrow": 1, "in two days": 2, "next week": 7, "in two weeks": 14}


def relative_date(text: Column, today: Column) -> Column:
    """The day that the first phrase of PHRASES found in a text means, null without any."""
    out = F.lit(None).cast("date")
    for phrase, days in reversed(PHRASES.items()):
        out = F.when(F.lower(text).contains(phrase), F.date_add(today, days)).otherwise(out)
    return out


def days_old(published: Column, today: Column) -> Column:
    return F.datediff(today, published)


def glob_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [...], [!...]) as a regular expression for the whole name."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def matches_glob(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_id(text: Column, size: int = 8) -> Column:
    return F.substring(text, 1, size)


def slice_key(labels: Column) -> Column:
    """A map as k=v pairs in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def full_key(metric: Column, key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", metric).otherwise(F.concat(metric, F.lit("["), key, F.lit("]")))


def nearest(name: str, known: list[str], cutoff: float = 0.6) -> str | None:
    """The known name that is most like a mistyped one; names are few and on the driver."""
    return next(iter(difflib.get_close_matches(name, known, 1, cutoff)), None)


def cut_text(text: Column, size: int) -> Column:
    """At most so many characters, without white space at the ends."""
    return F.trim(F.substring(F.trim(text), 1, size))


def first_label(text: Column, rules: list[tuple[str, str, float]], default: tuple[str, float] = ("other", 0.3)) -> tuple[Column, Column]:
    """(label, confidence) of the first (regular expression, label, confidence) that is found in the lower-cased text."""
    label, confidence = F.lit(default[0]), F.lit(default[1])
    for pattern, name, sure in reversed(rules):
        hit = F.coalesce(F.lower(text).rlike(pattern), F.lit(False))
        label, confidence = F.when(hit, name).otherwise(label), F.when(hit, sure).otherwise(confidence)
    return label, confidence


def headings(text: Column) -> Column:
    """Lines of a page that are marked as headings or numbered like them."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x.rlike(r"^(#{1,6} \S|[0-9]+(\.[0-9]+)* [A-Z])"))


def table_cells(text: Column) -> Column:
    """The filled cells of lines that are written as tables with bars."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\|.*\|$") & ~x.rlike(r"^[|\s:-]+$"))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))), lambda c: c != "")


def equations(text: Column) -> Column:
    """What stands between single dollar signs."""
    return F.regexp_extract_all(text, F.lit(r"\$([^$\n]+)\$"), 1)


def anchors(pages: Column, shift: int = 0) -> Column:
    """The citations of a document's pages (array of structs with `number` and `anchors`, an array of id and offset), in order: id, page, offset plus `shift`."""
    each = lambda p: F.transform(F.coalesce(p["anchors"], F.array()), lambda a: F.struct(a["id"].alias("id"), p["number"].cast("int").alias("page"), (a["offset"].cast("int") + shift).alias("offset")))
    return F.flatten(F.transform(pages, each))


def split_pages(pages: Column) -> Column:
    """Share of a document's pages, from 0 to 1, whose text doesn't break off inside a sentence; 1 without pages."""
    broken = F.size(F.filter(pages, lambda p: p["text"].rlike(r"[^.?!:|$\s]\s*\z")))
    return F.when(F.size(pages) > 0, 1 - broken / F.size(pages)).otherwise(1.0)


#: Phrases that try to give orders to a model.
INJECTIONS = r"ignore (all |any )?(previous|prior|above) instructions|disregard (the|your) (rules|instructions)|you are now|system prompt|reveal your"
#: Characters that are not seen.
HIDDEN = "[​‌‍⁠﻿­]"
#: Marks that a template was not filled in.
PLACEHOLDERS = r"\{\{[^}]*\}\}|\[(NAME|COMPANY|FIRST_NAME|TODO|INSERT[^\]]*)\]|<(name|company|first_name)>|\bTODO\b|\bTBD\b|lorem ipsum"


def injected(text: Column) -> Column:
    """Whether a text, without its hidden characters, gives orders."""
    return F.coalesce(F.lower(F.regexp_replace(text, HIDDEN, "")).rlike(INJECTIONS), F.lit(False))


def hides_text(text: Column) -> Column:
    return F.coalesce(text.rlike(HIDDEN), F.lit(False))


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(PLACEHOLDERS), F.lit(False))
